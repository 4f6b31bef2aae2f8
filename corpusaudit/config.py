"""Run options, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass

# The implemented voters, in their default order.
AGENTS = ("pattern_optimizer", "security_enforcer", "loop_simplifier")
# Names of the session states and of the kinds of edit.
STATUSES = ("started", "in_progress", "completed", "failed", "cancelled")
CHANGE_TYPES = ("optimization", "security", "readability", "performance", "structure")


@dataclass(frozen=True)
class AuditConfig:
    agent_set: tuple[str, ...] = AGENTS
    max_concurrent_agents: int = 5
    consensus_threshold: float = 0.6
    max_iterations: int = 10
    timeout_seconds: int = 300
    enable_evolution_log: bool = True
    snapshot_frequency: int = 5
    max_snapshots: int = 100
    backup_original: bool = True
    # "confidence" applies the best edit when its own confidence reaches the threshold,
    # "consensus" additionally asks for an accepting vote.
    gate: str = "confidence"
    # True also applies edits that span several lines.
    multi_line: bool = False
    # True gives single-line rewrites the indent of the line they replace.
    keep_indent: bool = False
    # True closes a file whose best edit cannot be applied; the final text is the same.
    early_stop: bool = False

    def __post_init__(self) -> None:
        def within(name: str, low: float, high: float | None) -> None:
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name}={value} is outside [{low}, {high}]")

        within("max_concurrent_agents", 1, 50)
        within("consensus_threshold", 0.0, 1.0)
        within("max_iterations", 1, 100)
        within("timeout_seconds", 10, None)
        within("snapshot_frequency", 1, None)
        within("max_snapshots", 1, None)
        if self.gate not in ("confidence", "consensus"):
            raise ValueError(f"gate={self.gate!r}")
        unknown = [a for a in self.agent_set if a not in AGENTS]
        if unknown:
            raise ValueError(f"AGENT_NOT_FOUND: {', '.join(unknown)}")
        if len(set(self.agent_set)) != len(self.agent_set):
            raise ValueError("agent_set lists an agent twice")
