"""Rule tables. Patterns are written in Python's dialect; ``jre`` turns them into Java's."""

from __future__ import annotations

from typing import NamedTuple


class Vulnerability(NamedTuple):
    rule_id: str
    # Lower-case literals that every match must contain. Rules that share a gate are skipped
    # together; texts without the needle skip the regex.
    gate: str
    category: str
    pattern: str
    needle: str
    # Same matches as ``pattern``, with possessive parts so that a failing search stays linear.
    search: str


# The 23 vulnerability patterns and their categories.
VULNERABILITIES = (
    Vulnerability("R0", "execute", "sql_injection", r"cursor\.execute\([^)]*%[^)]*\)", "cursor.execute(",
                  r"cursor\.execute\([^)%]*+%[^)]*+\)"),
    Vulnerability("R1", "execute", "sql_injection", r"\.format\([^)]*\).*execute", ".format(",
                  r"\.format\([^)]*+\).*execute"),
    Vulnerability("R2", "execute", "sql_injection", r'f".*{.*}.*".*execute', "execute",
                  r'f"(?>.*?\{)(?>.*?\})(?>.*?").*execute'),
    Vulnerability("R3", "execute", "sql_injection", r"execute\([^)]*\+[^)]*\)", "execute(",
                  r"execute\([^)+]*+\+[^)]*+\)"),
    Vulnerability("R4", "os.", "command_injection", r"os\.system\([^)]*\+", "os.system(",
                  r"os\.system\([^)]*\+"),
    Vulnerability("R5", "subprocess.", "command_injection", r"subprocess\.[^(]*\([^)]*\+", "subprocess.",
                  r"subprocess\.[^(]*+\([^)]*\+"),
    Vulnerability("R6", "eval(", "command_injection", r"eval\([^)]*input", "eval(", r"eval\([^)]*input"),
    Vulnerability("R7", "exec(", "command_injection", r"exec\([^)]*input", "exec(", r"exec\([^)]*input"),
    Vulnerability("R8", "../", "path_traversal", r"open\([^)]*\.\./.*\)", "open(", r"open\([^)]*\.\./.*\)"),
    Vulnerability("R9", "../", "path_traversal", r"""["'][^"']*\.\./[^"']*["']""", "../",
                  r"""["'][^"']*\.\./[^"']*["']"""),
    Vulnerability("R10", "os.", "path_traversal", r"os\.path\.join\([^)]*\.\.", "os.path.join(",
                  r"os\.path\.join\([^)]*\.\."),
    Vulnerability("R11", "password", "hardcoded_secrets", r"""password\s*=\s*["'][^"']{8,}["']""", "password",
                  r"""password\s*+=\s*+["'][^"']{8,}+["']"""),
    Vulnerability("R12", "api_key", "hardcoded_secrets", r"""api_key\s*=\s*["'][A-Za-z0-9+/=]{16,}["']""",
                  "api_key", r"""api_key\s*+=\s*+["'][A-Za-z0-9+/=]{16,}+["']"""),
    Vulnerability("R13", "secret", "hardcoded_secrets", r"""secret\s*=\s*["'][^"']{12,}["']""", "secret",
                  r"""secret\s*+=\s*+["'][^"']{12,}+["']"""),
    Vulnerability("R14", "token", "hardcoded_secrets", r"""token\s*=\s*["'][A-Za-z0-9+/=]{20,}["']""",
                  "token", r"""token\s*+=\s*+["'][A-Za-z0-9+/=]{20,}+["']"""),
    Vulnerability("R15", "hashlib.", "weak_crypto", r"hashlib\.md5\(", "hashlib.md5(", r"hashlib\.md5\("),
    Vulnerability("R16", "hashlib.", "weak_crypto", r"hashlib\.sha1\(", "hashlib.sha1(", r"hashlib\.sha1\("),
    Vulnerability("R17", "random.random()", "weak_crypto", r"random\.random\(\)", "random.random()",
                  r"random\.random\(\)"),
    Vulnerability("R18", "protocol_sslv", "weak_crypto", r"ssl.*PROTOCOL_SSLv[23]", "protocol_sslv",
                  r"ssl.*PROTOCOL_SSLv[23]"),
    Vulnerability("R19", ".loads(", "unsafe_deserialization", r"pickle\.loads\(", "pickle.loads(",
                  r"pickle\.loads\("),
    Vulnerability("R20", ".loads(", "unsafe_deserialization", r"marshal\.loads\(", "marshal.loads(",
                  r"marshal\.loads\("),
    Vulnerability("R21", "eval(", "unsafe_deserialization", r"eval\([^)]*\)", "eval(", r"eval\([^)]*+\)"),
    Vulnerability("R22", "exec(", "unsafe_deserialization", r"exec\([^)]*\)", "exec(", r"exec\([^)]*+\)"),
)

# Rules that look from a call up to its closing parenthesis. All calls between two closing ones
# share their end, so the first of them decides for all.
CALLS = {
    "R0": r"cursor\.execute\(",
    "R1": r"\.format\(",
    "R3": r"execute\(",
    "R4": r"os\.system\(",
    "R6": r"eval\(",
    "R7": r"exec\(",
    "R8": r"open\(",
    "R10": r"os\.path\.join\(",
    "R21": r"eval\(",
    "R22": r"exec\(",
}


def linear(rule: Vulnerability) -> str:
    """The search with its match as group 1. For the rules above it starts once per stretch of text
    between closing parentheses, or where the last match ended, so that unclosed calls do not each
    read the rest of the text."""
    call = CALLS.get(rule.rule_id)
    if call is None:
        return f"({rule.search})"
    return rf"(?:\G|(?<=\)))(?>[^)]*?(?={call}))({rule.search})"


# Names of the pattern and loop issues.
PATTERN_ISSUES = (
    "list_comprehension_opportunity",
    "ternary_operator_opportunity",
    "unnecessary_temp_variable",
    "string_concat_in_loop",
    "dict_get_opportunity",
)
LOOP_ISSUES = (
    "range_len_pattern",
    "nested_loop_with_append",
    "infinite_loop_with_break",
    "filter_opportunity",
    "map_opportunity",
    "manual_counting",
    "manual_sum",
    "excessive_nested_loops",
)

# Whole-text patterns of the issues above.
TERNARY = r"if\s+.+:\s*return\s+.+\s*else:\s*return"
TEMP_VARIABLE = r"^\s*(temp_|tmp_|temporary_)\w+\s*="
CONCAT_IN_LOOP = r"for\s+.+:\s*\w+\s*\+=\s*"
DICT_GET = r"if\s+\w+\s+in\s+\w+:\s*\w+\[\w+\]"
RANGE_LEN = r"for\s+\w+\s+in\s+range\(len\("
NESTED_APPEND = r"for.*\n.*for.*\n.*\.append"
FILTER_LOOP = r"for\s+\w+\s+in.*:\s*if\s+"
MAP_LOOP = r"for\s+\w+\s+in.*:\s*\w+\.append\(.*\w+.*\)"

# The same yes or no without starting again at every word: three lines in a row are looked for from
# the beginning of a line, and any letter of an argument decides.
NESTED_APPEND_SEARCH = r"(?:\A|(?<=\n))(?>.*?for).*+\n(?>.*?for).*+\n.*?\.append"
MAP_LOOP_SEARCH = r"for\s+\w+\s+in.*:\s*\w+\.append\((?>.*?\w).*\)"

# Three-part sequences: each part is looked for after the end of the one before it. Anchored and
# atomic, so every part takes its earliest place and a failing search reads the text once.
INFINITE_LOOP = r"\A(?>.*?while\s+True)(?>.*?\n)(?>.*?if)(?>.*?break)"
MANUAL_COUNT = r"\A(?>.*?count\s*+=\s*+0)(?>.*?for)(?>.*?count\s*+\+=\s*+1)"
MANUAL_SUM = r"\A(?>.*?sum\s*+=\s*+0)(?>.*?for)(?>.*?sum\s*+\+=)"

# What an edit must not bring in, and what counts as an improvement when it is gone.
UNSAFE_CODE = r"eval\(|exec\(|os\.system\(|shell\s*=\s*True|pickle\.loads\("
IMPROVEMENTS = (
    ("eval(", r"eval\("),
    ("exec(", r"exec\("),
    ("password", r"""password\s*=\s*["'][^"']*["']"""),
    ("cursor.execute(", r"cursor\.execute\([^)]*%"),
    ("os.system(", r"os\.system\([^)]*\+"),
)
CRITICAL_CALLS = ("eval(", "exec(", "os.system(")
