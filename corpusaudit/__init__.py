"""Set-based audit and refactoring of source-code corpora on Spark."""

from corpusaudit.config import AuditConfig

__all__ = ["AuditConfig"]
