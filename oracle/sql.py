"""DuckDB statements that compute every query a second way: joins over exploded lines instead of
expressions over arrays, and plain window functions instead of two-level aggregates."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]"
SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SPACES = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203),
          8232, 8233, 8239, 8287, 12288)
NL = "chr(10)"
_TRIM = " || ".join(f"chr({c})" for c in SPACES)

SNIPPETS = (
    'password = "hardcoded_secret_123"\napi_key = "sk1234567890abcdef"',
    'cursor.execute("SELECT * FROM users WHERE id = %s" % user_id)',
    'x = eval(input())\nos.system("rm " + p)',
    'h = hashlib.md5(data)\ntoken = random.random()\nf = open("../etc/p")',
    "for i in range(len(items)):\n    print(items[i])",
    "out = []\nfor x in xs:\n    if x > 0:\n        out.append(x)",
    "total = 0\nfor v in vals:\n    total += v",
    "while True:\n    n = n + 1\n    if n > 3: break\nz = 1",
    "for row in matrix:\n    for c in row:\n        flat.append(c)",
    "for it in items:\n    res.append(it * 2)",
    "if x > 0:\n    return 1\nelse:\n    return 2",
    "if k in d:\n    v = d[k]",
    "for s in ss:\n    acc += s",
    "temp_value = item * 2\nobj = pickle.loads(b)",
)
AGENTS = ("pattern_optimizer", "security_enforcer", "loop_simplifier")
KINDS = ("optimization", "security", "readability", "performance", "structure")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return q(pattern.replace(r"\w", WORD).replace(r"\s", SPACE))


def strip(x: str) -> str:
    return f"trim({x}, {_TRIM})"


def indent(x: str) -> str:
    return f"(length({x}) - length(ltrim({x}, {_TRIM})))"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {rx(pattern)})"


def extract(x: str, pattern: str, k: int) -> str:
    return f"regexp_extract({x}, {rx(pattern)}, {k})"


def count_in(x: str, literal: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(literal)}, ''))) // {len(literal)})"


def count_re(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {rx(pattern)}))"


def pick(values, index: str) -> str:
    return "[" + ", ".join(q(v) for v in values) + f"][({index}) % {len(values)} + 1]"


def path_of(doc_id: str) -> str:
    return f"source || '/m' || {doc_id} || " + pick(
        (".py", ".py", ".py", ".js", ".go", ".rb", ""), doc_id
    )


CORPUS = f"""corpus AS MATERIALIZED (
  SELECT doc_id AS file_id, {path_of('doc_id')} AS path,
    '# ' || replace(text, {NL}, {NL} || '# ') || {NL} || {pick(SNIPPETS, 'doc_id')} || {NL}
      || {pick(SNIPPETS, 'doc_id * 2 + 5')} || {NL} || {pick(SNIPPETS, 'doc_id * 3 + 10')} AS code
  FROM documents)"""

# The corpus with broken, empty and unreadable texts among the others.
DAMAGED = [
    CORPUS.replace("corpus AS", "whole AS", 1),
    f"""corpus AS MATERIALIZED (SELECT file_id, path, CASE WHEN file_id % 31 = 3 THEN 'def invalid syntax here +++' || {NL} || code
  WHEN file_id % 37 = 5 THEN '' WHEN file_id % 41 = 7 THEN NULL ELSE code END AS code FROM whole)""",
]

# ---------------------------------------------------------------- line rules

FOR_NAME = r"for\s+(\w+)\s+in\s+(\w+):"
FOR_ANY = r"for\s+(\w+)\s+in\s+(.+):"
APPEND = r"(\w+)\.append\((.+)\)"
IF_COLON = r"if\s+(.+):"
IF_IN = r"^\s*if\s+(\w+)\s+in\s+(\w+):"
RETURN = r"return\s+(.+)"
RANGE_LEN = r"for\s+(\w+)\s+in\s+range\(len\((\w+)\)\)"
ZERO = r"(\w+)\s*=\s*0"
ASSIGNED = r"(\w+)\s*="
WHILE = r"while\s+True:"


def _prop(rule, agent, kind, conf, impact, text, original, modified, end, source, where) -> str:
    return f"""SELECT file_id, {q(agent)} AS agent_id, {AGENTS.index(agent)} AS agent_ord,
  {q(rule)} AS rule_id, {int(rule[1:])} AS rule_ord, {q(kind)} AS change_type,
  {original} AS original_code, {modified} AS modified_code, i AS line_start, {end} AS line_end,
  {conf}::DOUBLE AS confidence, {q(text)} AS description, {impact}::DOUBLE AS impact_score
  FROM {source} WHERE {where}"""


def _security(ctx: str) -> list[str]:
    def one(rule, conf, impact, text, modified, where):
        return _prop(rule, "security_enforcer", "security", conf, impact, text,
                     "line", modified, "i", ctx, where)

    quoted = """["'][^"']*\\.\\./[^"']*["']"""
    var = extract("line", ASSIGNED, 1)
    return [
        one("D1", 0.9, 0.9, "Replace string formatting with parameterized queries",
            f"regexp_replace(line, {rx(r'%s|%d|%\w+')}, '?', 'g')",
            matches("line", r"cursor\.execute\([^)]*%") + " AND NOT contains(line, '?')"),
        one("D2", 0.8, 0.8, "Move hardcoded password to environment variable",
            f"""{var} || ' = os.environ.get("PASSWORD")'""",
            matches("line", r"""password\s*=\s*["'][^"']{8,}["']""")
            + " AND NOT contains(line, 'os.environ') AND NOT contains(line, 'getpass')"),
        one("D3", 0.8, 0.8, "Move hardcoded API key to environment variable",
            f"""{var} || ' = os.environ.get("API_KEY")'""",
            matches("line", r"""api_key\s*=\s*["'][A-Za-z0-9+/=]{16,}["']""")
            + " AND NOT contains(line, 'os.environ')"),
        one("D4", 0.95, 0.95, "Remove dangerous eval()/exec() with user input",
            q("# SECURITY: eval()/exec() with user input removed - use ast.literal_eval() for safe"
              " evaluation"),
            "(contains(line, 'eval(') OR contains(line, 'exec('))"
            " AND (contains(line, 'input(') OR contains(line, 'raw_input('))"),
        one("D5", 0.8, 0.7, "Replace weak hash algorithm with SHA-256",
            "replace(replace(line, 'hashlib.md5(', 'hashlib.sha256('),"
            " 'hashlib.sha1(', 'hashlib.sha256(')",
            "contains(line, 'hashlib.md5(') OR contains(line, 'hashlib.sha1(')"),
        one("D6", 0.85, 0.8, "Add path validation to prevent directory traversal",
            q("# SECURITY: Path traversal detected - validate and sanitize path")
            + f" || {NL} || line", matches("line", quoted)),
        one("D7", 0.7, 0.6, "Use cryptographically secure random for security purposes",
            "replace(line, 'random.random()', 'secrets.SystemRandom().random()')",
            "contains(line, 'random.random(') AND (contains(lower(line), 'password')"
            " OR contains(lower(line), 'token') OR contains(lower(line), 'secret'))"),
        one("D8", 0.9, 0.85, "Replace os.system() with safer subprocess call",
            q("# SECURITY: Use subprocess with shell=False instead of os.system()"),
            matches("line", r"os\.system\([^)]*\+")),
    ]


def _pattern(ctx: str) -> list[str]:
    agent = "pattern_optimizer"
    two = f"line || {NL} || n1"
    item, target = extract("line", FOR_ANY, 1), extract(strip("n1"), APPEND, 1)
    source, value = extract("line", FOR_ANY, 2), extract(strip("n1"), APPEND, 2)
    key, name = extract("line", IF_IN, 1), extract("line", IF_IN, 2)
    last = "coalesce(n3, '')"
    return [
        _prop("D9", agent, "optimization", 0.7, 0.6, "Convert to list comprehension", two,
              f"CASE WHEN {strip(value)} = {item} THEN {target} || ' = list(' || {source} || ')'"
              f" ELSE {target} || ' = [' || {value} || ' for ' || {item} || ' in ' || {source}"
              " || ']' END",
              "i + 1", ctx,
              "contains(line, 'for') AND contains(n1, '.append(')"
              f" AND NOT starts_with({strip('line')}, '#') AND {matches('line', FOR_ANY)}"
              f" AND {matches(strip('n1'), APPEND)}"),
        _prop("D10", agent, "optimization", 0.8, 0.5, "Convert to ternary operator",
              strip(f"line || {NL} || n1 || {NL} || n2 || {NL} || {last}"),
              f"'return ' || {extract(strip('n1'), RETURN, 1)} || ' if ' ||"
              f" {extract('line', IF_COLON, 1)} || ' else ' || {extract(strip(last), RETURN, 1)}",
              "i + 3", ctx,
              f"{matches('line', IF_COLON)} AND contains(n1, 'return') AND contains(n2, 'else:')"
              f" AND {matches(strip('n1'), RETURN)} AND {matches(strip(last), RETURN)}"),
        _prop("D11", agent, "performance", 0.6, 0.7,
              "Use join() instead of string concatenation in loop", two,
              q("# Consider using join() instead of string concatenation") + f" || {NL} || {two}",
              "i + 1", ctx,
              matches("line", r"for\s+.+:") + " AND " + matches("n1", r"\w+\s*\+=\s*")),
        _prop("D12", agent, "optimization", 0.9, 0.4, "Use dict.get() instead of key checking", two,
              f"replace(n1, {name} || '[' || {key} || ']', {name} || '.get(' || {key} || ')')",
              "i + 1", ctx,
              f"{matches('line', IF_IN)} AND contains(n1, {name} || '[' || {key} || ']')"),
    ]


def _loop(k: str) -> list[str]:
    agent, ctx = "loop_simplifier", f"branch{k}"
    bare = strip("line")
    i_name, xs = extract("line", RANGE_LEN, 1), extract("line", RANGE_LEN, 2)
    three = f"{bare} || {NL} || n1 || {NL} || n2"
    body = strip("n2")
    var, items = extract("line", FOR_NAME, 1), extract("line", FOR_NAME, 2)
    total = extract("line", ZERO, 1)
    var1, items1 = extract("n1", FOR_NAME, 1), extract("n1", FOR_NAME, 2)
    return [
        _prop("D13", agent, "optimization", 0.9, 0.6, "Replace range(len()) with enumerate()", bare,
              f"replace({bare}, 'for ' || {i_name} || ' in range(len(' || {xs} || '))',"
              f" 'for ' || {i_name} || ', item in enumerate(' || {xs} || ')')",
              "i", ctx, "branch = 13"),
        _prop("D14", agent, "optimization", 0.8, 0.7, "Convert filter loop to list comprehension",
              three,
              f"{strip(f'''split_part({body}, '.append', 1)''')} || ' = [item for item in ' ||"
              f" {items} || ' if ' || {extract('n1', IF_COLON, 1)} || ']'",
              "i + 2", ctx,
              f"branch = 14 AND {matches('n1', IF_COLON)}"
              f" AND ends_with({body}, '.append(' || {var} || ')')"),
        _prop("D15", agent, "performance", 0.9, 0.8, "Replace manual sum with built-in sum()", three,
              f"{total} || ' = sum(' || {items1} || ')'", "i + 2", ctx,
              f"branch = 15 AND {matches('n1', FOR_NAME)} AND contains(n2, {total} || ' +=')"
              f" AND {body} = {total} || ' += ' || {var1}"),
        _prop("D16", agent, "optimization", 0.6, 0.5, "Consider refactoring while True loop", "txt",
              f"'# Consider refactoring infinite loop' || {NL} || txt", "e", f"block{k}",
              "branch = 16 AND contains(txt, 'break')"),
        _prop("D17", agent, "performance", 0.7, 0.7, "Optimize nested loop structure", "txt",
              f"'# Consider nested comprehension:' || {NL} || '# ' || {extract('appending', APPEND, 1)}"
              f" || ' = [' || {extract('appending', APPEND, 2)} || ' for ' || {var} || ' in ' ||"
              f" {items} || ' for ' || {extract('inner_line', FOR_NAME, 1)} || ' in ' ||"
              f" {extract('inner_line', FOR_NAME, 2)} || ']' || {NL} || txt",
              "e", f"nested{k}", "true"),
    ]


def lines_ctes(k: str, table: str) -> list[str]:
    """ctx: every line with what follows it. Sites, blocks and branches of the loop rules."""
    return [
        f"""ctx{k} AS MATERIALIZED (
  SELECT *, lead(line, 1) OVER w AS n1, lead(line, 2) OVER w AS n2, lead(line, 3) OVER w AS n3,
    {indent('line')} AS ind, {strip('line')} = '' AS blank
  FROM (SELECT file_id, len(l) AS n, unnest(range(len(l))) AS i, unnest(l) AS line
        FROM (SELECT file_id, string_split(code, {NL}) AS l FROM {table}))
  WINDOW w AS (PARTITION BY file_id ORDER BY i))""",
        f"""site{k} AS MATERIALIZED (
  SELECT DISTINCT o.file_id, o.i FROM ctx{k} o
  JOIN ctx{k} f ON f.file_id = o.file_id AND f.i BETWEEN o.i + 1 AND o.i + 9
    AND contains(f.line, 'for ') AND f.ind > o.ind
  JOIN ctx{k} a ON a.file_id = f.file_id AND a.i BETWEEN f.i + 1 AND f.i + 4
    AND contains(a.line, '.append(')
  WHERE starts_with({strip('o.line')}, 'for ') AND o.i < o.n - 2)""",
        f"""branch{k} AS MATERIALIZED (
  SELECT c.*, CASE WHEN {matches('line', RANGE_LEN)} THEN 13
    WHEN {matches('line', FOR_NAME)} AND {matches('n1', 'if' + chr(92) + 's+')} THEN 14
    WHEN {matches('line', ZERO)} AND contains(n1, 'for ') THEN 15
    WHEN {matches('line', WHILE)} THEN 16 WHEN s.i IS NOT NULL THEN 17 END AS branch
  FROM ctx{k} c LEFT JOIN site{k} s ON s.file_id = c.file_id AND s.i = c.i)""",
        f"""ends{k} AS MATERIALIZED (
  SELECT s.file_id, s.i, any_value(s.branch) AS branch, any_value(s.line) AS line,
    coalesce(min(l.i), any_value(s.n)) - 1 AS e
  FROM (SELECT * FROM branch{k} WHERE branch IN (16, 17)) s
  LEFT JOIN ctx{k} l ON l.file_id = s.file_id AND l.i > s.i AND l.ind <= s.ind AND NOT l.blank
  GROUP BY s.file_id, s.i)""",
        f"""block{k} AS MATERIALIZED (
  SELECT b.file_id, b.i, any_value(b.e) AS e, any_value(b.branch) AS branch,
    any_value(b.line) AS line, string_agg(l.line, {NL} ORDER BY l.i) AS txt
  FROM ends{k} b JOIN ctx{k} l ON l.file_id = b.file_id AND l.i BETWEEN b.i AND b.e
  WHERE b.e > b.i GROUP BY b.file_id, b.i)""",
        f"""inner{k} AS (
  SELECT b.file_id, b.i, min(l.i) AS j, arg_min(l.line, l.i) AS inner_line
  FROM block{k} b JOIN ctx{k} l ON l.file_id = b.file_id AND l.i > b.i AND l.i <= b.e
    AND {matches('l.line', FOR_NAME)}
  WHERE b.branch = 17 AND b.e - b.i >= 2 AND {matches('b.line', FOR_NAME)}
  GROUP BY b.file_id, b.i)""",
        f"""nested{k} AS (
  SELECT b.file_id, b.i, any_value(b.e) AS e, any_value(b.line) AS line, any_value(b.txt) AS txt,
    any_value(x.inner_line) AS inner_line, arg_min(l.line, l.i) AS appending
  FROM block{k} b JOIN inner{k} x ON x.file_id = b.file_id AND x.i = b.i
  JOIN ctx{k} l ON l.file_id = b.file_id AND l.i > x.j AND l.i <= b.e
    AND {matches('l.line', APPEND)}
  GROUP BY b.file_id, b.i)""",
    ]


def proposal_ctes(k: str, table: str) -> list[str]:
    edits = _security(f"ctx{k}") + _pattern(f"ctx{k}") + _loop(k)
    union = "\n  UNION ALL ".join(edits)
    return lines_ctes(k, table) + [f"props{k} AS MATERIALIZED (\n  {union})"]


C = "confidence"
SCORES = f"""
  CASE change_type WHEN 'optimization' THEN least({C} * 1.2, 1.0)
    WHEN 'performance' THEN least({C} * 1.1, 1.0) WHEN 'security' THEN {C} * 0.9
    ELSE {C} * 0.8 END AS s_pattern_optimizer,
  CASE WHEN change_type = 'security' THEN least({C} * 1.5, 1.0)
    WHEN change_type <> 'optimization' THEN {C} * 0.7
    WHEN {matches('modified_code', r'eval\(|exec\(|os\.system\(|shell\s*=\s*True|pickle\.loads\(')}
    THEN 0.1 ELSE {C} * 0.9 END AS s_security_enforcer,
  CASE WHEN regexp_matches(lower(description), 'loop|comprehension|enumerate|built-in')
    THEN least({C} * 1.3, 1.0) WHEN change_type = 'performance' THEN {C} * 1.1
    WHEN change_type = 'optimization' THEN {C} * 1.0 ELSE {C} * 0.6 END AS s_loop_simplifier"""
KEY = "agent_id || '_' || line_start || '_' || change_type"


def decision_ctes(k: str, source: str, weights=(1 / 3, 1 / 3, 1 / 3)) -> list[str]:
    total = " + ".join(f"s_{a} * {w!r}::DOUBLE" for a, w in zip(AGENTS, weights))
    means = ", ".join(f"avg(s_{a}) AS a_{a}" for a in AGENTS)
    best = "greatest(" + ", ".join(f"round(a_{a}, 12)" for a in AGENTS) + ")"
    winner = " ".join(f"WHEN round(a_{a}, 12) = {best} THEN {q(a)}" for a in AGENTS)
    return [
        f"""scored{k} AS MATERIALIZED (
  SELECT *, {total} AS key_score FROM (
    SELECT file_id, {KEY} AS vote_key, agent_ord, line_start, rule_ord, {SCORES} FROM {source})
  QUALIFY row_number() OVER (PARTITION BY file_id, vote_key
    ORDER BY agent_ord DESC, line_start DESC, rule_ord DESC) = 1)""",
        f"""decided{k} AS MATERIALIZED (
  SELECT *, CASE WHEN decision = 'accept_changes' THEN CASE {winner} END ELSE 'none' END
      AS winning_agent,
    CASE decision WHEN 'accept_changes' THEN average WHEN 'reject_changes' THEN 1 - average
      ELSE 0 END::DOUBLE AS confidence
  FROM (SELECT *, CASE WHEN n_keys IS NULL THEN 'no_changes'
      WHEN round(average, 12) >= 0.6::DOUBLE THEN 'accept_changes' ELSE 'reject_changes' END AS decision
    FROM (SELECT c.file_id, v.* EXCLUDE (file_id) FROM corpus c LEFT JOIN (
      SELECT file_id, count(*) AS n_keys, avg(key_score) AS average, {means}
      FROM scored{k} GROUP BY file_id) v ON v.file_id = c.file_id)))""",
    ]


# Rules of a user agent, tried on every line beside the built-in ones.
USER_RULES = """rule AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY rule_id) - 1 AS rule_ord FROM (
  SELECT * FROM (VALUES ('U_item', '\\btemp_value\\b', 'item_twice', 0.9::DOUBLE),
    ('U_grid', '\\bin matrix:', 'in grid:', 0.75), ('U_vals', 'for v in vals', 'for value in values', 0.65),
    ('U_load', 'pickle\\.loads\\((\\w+)\\)', 'json.loads(\\1)', 0.95)) v(rule_id, pattern, replacement, confidence)
  UNION ALL SELECT DISTINCT 'U_' || lang, '^# ' || lang || ' ', '# ' || lang || ': ', 0.7 FROM documents))"""


def user_ctes(k: str) -> str:
    return f"""props{k} AS MATERIALIZED (SELECT * FROM own{k} UNION ALL
  SELECT file_id, 'user_rules' AS agent_id, 3 AS agent_ord, rule_id, rule_ord, 'readability' AS change_type, line AS original_code,
    regexp_replace(line, pattern, replacement, 'g') AS modified_code, i AS line_start, i AS line_end, confidence,
    'naming' AS description, 0.1::DOUBLE AS impact_score FROM ctx{k}, rule WHERE regexp_matches(line, pattern))"""


def round_ctes(k: str, table: str, user: bool = False) -> list[str]:
    proposed = proposal_ctes(k, table)
    if user:
        proposed[-1] = proposed[-1].replace(f"props{k} AS", f"own{k} AS", 1)
        proposed.append(user_ctes(k))
    return proposed + [
        f"""useful{k} AS MATERIALIZED (
  SELECT p.*, l.line FROM props{k} p
  JOIN ctx{k} l ON l.file_id = p.file_id AND l.i = p.line_start
  WHERE {strip('p.modified_code')} <> {strip('l.line')})""",
        f"""best{k} AS MATERIALIZED (
  SELECT *, {strip('line')} = {strip('original_code')} AS fits FROM useful{k}
  QUALIFY row_number() OVER (PARTITION BY file_id
    ORDER BY confidence DESC, agent_ord, line_start, rule_ord) = 1)""",
        f"""after{k} AS MATERIALIZED (
  SELECT l.file_id, string_agg(CASE WHEN l.i = b.line_start THEN b.modified_code ELSE l.line END,
    {NL} ORDER BY l.i) AS code
  FROM ctx{k} l JOIN best{k} b ON b.file_id = l.file_id
  WHERE b.confidence >= 0.6::DOUBLE AND b.fits GROUP BY l.file_id)""",
    ]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def corpus(body: str) -> str:
    return with_([CORPUS], body)


def on_lines(body: str) -> str:
    return with_([CORPUS, *lines_ctes("0", "corpus")], body)


def on_props(body: str) -> str:
    return with_([CORPUS, *proposal_ctes("0", "corpus")], body)


def on_votes(body: str, **kw) -> str:
    return with_([CORPUS, *proposal_ctes("0", "corpus"), *decision_ctes("0", "props0", **kw)], body)


def on_round(body: str) -> str:
    """pair: every file before and after one round."""
    pair = """pair AS MATERIALIZED (SELECT c.file_id, c.path, c.code AS a,
  coalesce(n.code, c.code) AS b, n.code IS NOT NULL AS applied
  FROM corpus c LEFT JOIN after0 n ON n.file_id = c.file_id)"""
    return with_([CORPUS, *round_ctes("0", "corpus"), *decision_ctes("0", "useful0"), pair], body)


PROP_COLUMNS = """file_id, agent_id, rule_id, rule_ord, change_type, original_code,
  modified_code, line_start, line_end, confidence, description, impact_score"""
PROPS_ALL = PROP_COLUMNS.replace("agent_id,", "agent_id, agent_ord,")

# ---------------------------------------------------------------- whole-text rules

VULNERABILITIES = (
    ("sql_injection", r"cursor\.execute\([^)]*%[^)]*\)"),
    ("sql_injection", r"\.format\([^)]*\).*execute"),
    ("sql_injection", r'f".*{.*}.*".*execute'),
    ("sql_injection", r"execute\([^)]*\+[^)]*\)"),
    ("command_injection", r"os\.system\([^)]*\+"),
    ("command_injection", r"subprocess\.[^(]*\([^)]*\+"),
    ("command_injection", r"eval\([^)]*input"),
    ("command_injection", r"exec\([^)]*input"),
    ("path_traversal", r"open\([^)]*\.\./.*\)"),
    ("path_traversal", r"""["'][^"']*\.\./[^"']*["']"""),
    ("path_traversal", r"os\.path\.join\([^)]*\.\."),
    ("hardcoded_secrets", r"""password\s*=\s*["'][^"']{8,}["']"""),
    ("hardcoded_secrets", r"""api_key\s*=\s*["'][A-Za-z0-9+/=]{16,}["']"""),
    ("hardcoded_secrets", r"""secret\s*=\s*["'][^"']{12,}["']"""),
    ("hardcoded_secrets", r"""token\s*=\s*["'][A-Za-z0-9+/=]{20,}["']"""),
    ("weak_crypto", r"hashlib\.md5\("),
    ("weak_crypto", r"hashlib\.sha1\("),
    ("weak_crypto", r"random\.random\(\)"),
    ("weak_crypto", r"ssl.*PROTOCOL_SSLv[23]"),
    ("unsafe_deserialization", r"pickle\.loads\("),
    ("unsafe_deserialization", r"marshal\.loads\("),
    ("unsafe_deserialization", r"eval\([^)]*\)"),
    ("unsafe_deserialization", r"exec\([^)]*\)"),
)


def _re2_braces(pattern: str) -> str:
    return pattern.replace('f".*{.*}', r'f".*\{.*\}')


def vuln_cte(source: str, name: str = "vuln", code: str = "code") -> str:
    parts = [
        f"SELECT file_id, 'R{i}' AS rule_id, {q(c)} AS category, {q(c + ':' + p)} AS label,"
        f" regexp_extract_all({code}, {rx('(?i)' + _re2_braces(p))}) AS m FROM {source}"
        for i, (c, p) in enumerate(VULNERABILITIES)
    ]
    return f"{name} AS MATERIALIZED (" + "\n  UNION ALL ".join(parts) + ")"


def on_vulns(body: str) -> str:
    return with_([CORPUS, vuln_cte("corpus")], body)


PATTERN_TEXTS = (
    ("ternary_operator_opportunity", r"if\s+.+:\s*return\s+.+\s*else:\s*return"),
    ("string_concat_in_loop", r"for\s+.+:\s*\w+\s*\+=\s*"),
    ("dict_get_opportunity", r"if\s+\w+\s+in\s+\w+:\s*\w+\[\w+\]"),
)
LOOP_TEXTS = (
    ("range_len_pattern", r"for\s+\w+\s+in\s+range\(len\("),
    ("nested_loop_with_append", r"for.*\n.*for.*\n.*\.append"),
    ("infinite_loop_with_break", r"(?s)while\s+True.*\n.*if.*break"),
    ("filter_opportunity", r"for\s+\w+\s+in.*:\s*if\s+"),
    ("map_opportunity", r"for\s+\w+\s+in.*:\s*\w+\.append\(.*\w+.*\)"),
    ("manual_counting", r"(?s)count\s*=\s*0.*for.*count\s*\+=\s*1"),
    ("manual_sum", r"(?s)sum\s*=\s*0.*for.*sum\s*\+="),
)


def _flags(texts) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT file_id, {q(name)} AS issue, 1::BIGINT AS n_found FROM corpus"
        f" WHERE {matches('code', pattern)}"
        for name, pattern in texts
    )


LOOPS = f"({count_in('code', 'for ')} + {count_in('code', 'while ')})"
PATTERN_CTE = f"""pattern_issue AS MATERIALIZED ({_flags(PATTERN_TEXTS)}
  UNION ALL SELECT file_id, 'list_comprehension_opportunity', count(*) FROM ctx0
    WHERE contains(line, 'for') AND contains(n1, '.append(') GROUP BY file_id
  UNION ALL SELECT file_id, 'unnecessary_temp_variable', count(*) FROM ctx0
    WHERE {matches('line', r'^\s*(temp_|tmp_|temporary_)\w+\s*=')} GROUP BY file_id)"""
LOOP_CTE = f"""loop_issue AS MATERIALIZED ({_flags(LOOP_TEXTS)}
  UNION ALL SELECT file_id, 'excessive_nested_loops', 1 FROM corpus WHERE {LOOPS} > 3)"""


def _analysis(source: list[str], body: str) -> str:
    def agent(name, table, n, yes, no):
        return f"""SELECT c.file_id, {q(name)} AS agent_id, coalesce(f.n, 0)::BIGINT AS issues_found,
    CASE WHEN f.n > 0 THEN {yes} ELSE {no} END::DOUBLE AS confidence
    FROM corpus c LEFT JOIN (SELECT file_id, sum({n}) AS n FROM {table} GROUP BY file_id) f
    ON f.file_id = c.file_id"""

    found = "\n  UNION ALL ".join(
        (
            agent("pattern_optimizer", "pattern_issue", "n_found", 0.8, 0.5),
            agent("security_enforcer", "vuln", "len(m)", 0.9, 0.7),
            agent("loop_simplifier", "loop_issue", "n_found", 0.8, 0.6),
        )
    )
    return with_(
        [*source, *lines_ctes("0", "corpus"), PATTERN_CTE, LOOP_CTE, vuln_cte("corpus"), f"found AS ({found})"], body
    )


# ---------------------------------------------------------------- before and after


def complexity(x: str) -> str:
    words = " + ".join(
        count_in(x, w) for w in ("if ", "for ", "while ", "try:", "except ", "def ")
    )
    deepest = (
        f"list_max(list_transform(string_split({x}, {NL}), lambda t:"
        f" CASE WHEN {strip('t')} = '' THEN 0 ELSE {indent('t')} END))"
    )
    return f"CASE WHEN {strip(x)} = '' THEN 0 ELSE 1 + {words} + {deepest} / 4 END::DOUBLE"


IMPROVED = (r"eval\(", r"exec\(", r"""password\s*=\s*["'][^"']*["']""",
            r"cursor\.execute\([^)]*%", r"os\.system\([^)]*\+")


def _issues(x: str) -> str:
    return "(" + " + ".join(count_re(x, "(?i)" + p) for p in IMPROVED) + ")"


IMPROVEMENTS = f"greatest(0, {_issues('a')} - {_issues('b')})::BIGINT"
GAINS = f"""((CASE WHEN contains(b, '[') AND contains(b, 'for')
    AND {count_in('a', 'append')} > {count_in('b', 'append')} THEN 0.2::DOUBLE ELSE 0::DOUBLE END)
  + (CASE WHEN contains(b, 'enumerate') AND contains(a, 'range(len(') THEN 0.1::DOUBLE ELSE 0::DOUBLE END)
  + (CASE WHEN contains(b, 'yield') AND contains(a, 'return') THEN 0.3::DOUBLE ELSE 0::DOUBLE END))"""
DELTA = f"round({complexity('b')} - {complexity('a')}, 9)"


def _vuln_total(x: str) -> str:
    return "(" + " + ".join(count_re(x, "(?i)" + _re2_braces(p)) for _, p in VULNERABILITIES) + ")"


# ---------------------------------------------------------------- fix-point, round by round


def _fixpoint(rounds: int, body: str, source: list[str] = [CORPUS], user: bool = False) -> str:
    """The loop written out: every round works on the files that are still open."""
    ctes = [
        *source,
        f"""state0 AS MATERIALIZED (SELECT file_id, code, 0 AS stalls, NULL::VARCHAR AS reason,
  0 AS rounds, 0 AS n_steps, 0 AS n_decisions, range(len(string_split(code, {NL}))) AS origin FROM corpus)""",
    ]
    for k in range(rounds):
        ctes.append(f"open{k} AS MATERIALIZED (SELECT * FROM state{k} WHERE reason IS NULL)")
        ctes += round_ctes(str(k), f"open{k}", user)
        ctes.append(f"""state{k + 1} AS MATERIALIZED (
  SELECT s.file_id, coalesce(n.code, s.code) AS code,
    CASE WHEN p.file_id IS NULL THEN s.stalls WHEN b.file_id IS NULL THEN s.stalls + 1
      WHEN n.file_id IS NULL THEN 1 ELSE 0 END AS stalls,
    CASE WHEN p.file_id IS NULL THEN 'no_changes'
      WHEN b.file_id IS NULL AND s.stalls + 1 >= 3 THEN 'stalled' END AS reason,
    {k + 1} AS rounds, s.n_steps + (n.file_id IS NOT NULL)::INT AS n_steps,
    s.n_decisions + (b.file_id IS NOT NULL)::INT AS n_decisions,
    CASE WHEN n.file_id IS NULL THEN s.origin ELSE s.origin[1:b.line_start]
      || list_transform(string_split(b.modified_code, {NL}), lambda x: -1::BIGINT) || s.origin[b.line_start + 2:] END AS origin
  FROM open{k} s LEFT JOIN (SELECT DISTINCT file_id FROM props{k}) p USING (file_id)
  LEFT JOIN best{k} b USING (file_id) LEFT JOIN after{k} n USING (file_id)
  UNION ALL SELECT * FROM state{k} WHERE reason IS NOT NULL)""")
    ctes.append(f"""done AS (SELECT file_id, code AS refactored_code, n_steps, n_decisions, rounds,
  coalesce(reason, 'max_iterations') AS reason FROM state{rounds})""")
    ctes.append("""pair AS (SELECT c.file_id, c.path, c.code AS a, d.refactored_code AS b
  FROM corpus c JOIN done d USING (file_id))""")
    applied = " UNION ALL ".join(
        f"""SELECT file_id, {k} AS k, b.agent_id || ': ' || b.description || ' (confidence: '
    || printf('%.2f', b.confidence) || ')' AS change, b.agent_id, b.modified_code FROM best{k} b SEMI JOIN after{k} USING (file_id)"""
        for k in range(rounds)
    )
    ctes.append(f"""applied AS (SELECT file_id, count(*) AS n_steps,
  string_agg(change, {NL} ORDER BY k) AS changes, string_agg(DISTINCT agent_id, '|' ORDER BY agent_id) AS agents,
  string_agg(modified_code, '|' ORDER BY k) AS edits, count(*) FILTER (agent_id = 'user_rules') AS user_steps
  FROM ({applied}) GROUP BY file_id)""")
    ctes.append(f"""shares AS (SELECT file_id, string_agg(agent_id || '=' || n, '|' ORDER BY agent_id) AS shares
  FROM (SELECT file_id, agent_id, count(*) AS n FROM ({applied}) GROUP BY ALL) GROUP BY file_id)""")
    ctes.append(f"""changed AS (SELECT file_id, sum(abs(n))::BIGINT AS lines_changed FROM (
    SELECT file_id, line, sum(sign) AS n FROM (
      SELECT file_id, unnest(string_split(a, {NL})) AS line, 1 AS sign FROM pair WHERE a <> b
      UNION ALL SELECT file_id, unnest(string_split(b, {NL})), -1 FROM pair WHERE a <> b)
    GROUP BY file_id, line) GROUP BY file_id)""")
    # What the edits removed and brought in, in hunks parted by kept lines; chains of equal lines inside
    # a hunk are lines that did not change after all.
    ctes += [
        f"""lists AS MATERIALIZED (SELECT c.file_id, string_split(c.code, {NL}) AS a_lines,
  string_split(s.code, {NL}) AS b_lines, s.origin FROM corpus c JOIN state{rounds} s USING (file_id) WHERE c.code <> s.code)""",
        """gone AS MATERIALIZED (SELECT file_id, i, line, i - row_number() OVER (PARTITION BY file_id ORDER BY i) AS spot
  FROM (SELECT file_id, origin, unnest(range(len(a_lines))) AS i, unnest(a_lines) AS line FROM lists)
  WHERE NOT list_contains(origin, i))""",
        """fresh AS MATERIALIZED (SELECT file_id, i, line, i - row_number() OVER (PARTITION BY file_id ORDER BY i) AS spot
  FROM (SELECT file_id, unnest(range(len(b_lines))) AS i, unnest(b_lines) AS line, unnest(origin) AS o FROM lists) WHERE o < 0)""",
        """same AS MATERIALIZED (SELECT g.file_id, g.spot, g.i, f.i AS j FROM gone g JOIN fresh f
  ON g.file_id = f.file_id AND g.spot = f.spot AND g.line = f.line)""",
        """chain AS (SELECT file_id, spot, i, j, 1 AS n FROM same UNION SELECT s.file_id, s.spot, s.i, s.j, c.n + 1
  FROM chain c JOIN same s ON s.file_id = c.file_id AND s.spot = c.spot AND s.i > c.i AND s.j > c.j)""",
        """in_order AS (SELECT file_id, sum(n)::BIGINT AS lines_changed FROM (
    SELECT file_id, count(*) AS n FROM gone GROUP BY file_id UNION ALL SELECT file_id, count(*) FROM fresh GROUP BY file_id
    UNION ALL SELECT file_id, -2 * max(n) FROM chain GROUP BY file_id, spot) GROUP BY file_id)""",
    ]
    return "WITH RECURSIVE " + with_(ctes, body).removeprefix("WITH ")


# ---------------------------------------------------------------- sessions

SESSION = "'00000000-0000-4000-8000-' || lpad({0}::VARCHAR, 12, '0')"
TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
VERSIONS = f"""versions AS MATERIALIZED (SELECT
  CASE WHEN event_id % 50 = 0 THEN 'bad-' || user_id ELSE {SESSION.format('user_id')} END AS refactor_id,
  'src/m' || user_id || '.py' AS target_path, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'completed'
    WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status,
  (floor(value)::BIGINT % 101) AS progress FROM events)"""
CURRENT = """current AS MATERIALIZED (SELECT *, min(ts) OVER (PARTITION BY refactor_id) AS started_at
  FROM versions QUALIFY row_number() OVER (PARTITION BY refactor_id ORDER BY ts DESC, seq DESC) = 1)"""
STEPS = f"""steps AS MATERIALIZED (SELECT {SESSION.format('user_id')} AS refactor_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iteration,
  {pick(AGENTS, 'event_id')} AS agent, {pick(KINDS, 'event_id')} AS change_type,
  (event_id % 100)::DOUBLE / 100 AS confidence, ts FROM events)"""
SNAPSHOTS = """snapshots AS MATERIALIZED (SELECT refactor_id, refactor_id || '_iter_' || iteration
    || CASE WHEN iteration % 20 = 15 THEN 'x' ELSE '' END || '.py' AS name, iteration, ts AS mtime
  FROM steps WHERE iteration % 5 = 0)"""
WANTED = f"wanted AS (SELECT {SESSION.format('c_custkey')} AS refactor_id FROM customer)"
DROPPED = f"dropped AS (SELECT {SESSION.format('s_suppkey')} AS refactor_id FROM supplier)"
REQUESTS = f"""requests AS (SELECT unnest([{pick(AGENTS, 'event_id')},
  {pick((*AGENTS, 'performance_optimizer', 'readability_enhancer', 'style_fixer',
         'type_annotator'), 'event_id')}]) AS agent_id FROM events)"""
CURRENT_ROW = f"""refactor_id, target_path, status, progress, {TIME.format('started_at')} AS started_at,
  {TIME.format('ts')} AS updated_at, seq"""
STEP_ROW = f"""refactor_id, iteration, agent, change_type, round(confidence, 9) AS confidence,
  {TIME.format('ts')} AS ts"""
CUTOFF = "TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY"


def sessions(body: str, *extra: str) -> str:
    return with_([VERSIONS, CURRENT, *extra], body)


def steps(body: str, *extra: str) -> str:
    return with_([STEPS, *extra], body)


def _histogram() -> str:
    bounds = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
    rows = [
        f"SELECT agent, {q(str(b))} AS le, count(*) FILTER (seconds <= {b}::DOUBLE) AS cumulative,"
        " round(sum(seconds), 9) AS sum_seconds, count(*) AS n FROM lat GROUP BY agent"
        for b in bounds
    ] + ["SELECT agent, 'inf', count(*), round(sum(seconds), 9), count(*) FROM lat GROUP BY agent"]
    lat = f"lat AS (SELECT {pick(AGENTS, 'event_id')} AS agent, value / 100 AS seconds FROM events)"
    return with_([lat], "\n  UNION ALL ".join(rows))


def _override() -> str:
    tests = []
    for agent in ("security_enforcer", "loop_simplifier"):
        mean = f"coalesce(a_{agent}, 0)"
        tests.append(
            f"WHEN round({mean}, 12) > 0.9::DOUBLE THEN {{'d': 'priority_override_accept',"
            f" 'w': {q(agent)}, 'c': {mean}}}"
            f" WHEN round({mean}, 12) < 0.1::DOUBLE THEN {{'d': 'priority_override_reject',"
            f" 'w': {q(agent)}, 'c': 1 - {mean}}}"
        )
    return on_votes(
        "SELECT file_id, r.d AS decision, r.w AS winning_agent, round(r.c, 9) AS confidence, n_keys"
        f" FROM (SELECT file_id, coalesce(n_keys, 0) AS n_keys, CASE {' '.join(tests)}"
        " ELSE {'d': decision, 'w': winning_agent, 'c': confidence} END AS r FROM decided0)"
    )


def _votes(agent: str) -> str:
    return on_props(
        f"SELECT file_id, agent_ord, line_start, rule_ord, vote_key, round(s_{agent}, 9) AS score"
        f" FROM (SELECT *, {KEY} AS vote_key, {SCORES} FROM props0)"
    )


def _ballots(source: str, columns: str, failed: str | None = None) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT {columns}, {q(a)} AS voter, {i} AS voter_ord, "
        + (
            "neutral_key AS vote_key, 0.5::DOUBLE AS score"
            if a == failed
            else f"vote_key, round(s_{a}, 9) AS score"
        )
        + f" FROM {source}"
        for i, a in enumerate(AGENTS)
    )


def statements() -> dict[str, str]:
    voted = f"""voted AS (SELECT *, {KEY} AS vote_key, 'change_' || (row_number() OVER (
    PARTITION BY file_id ORDER BY agent_ord, line_start, rule_ord) - 1) AS neutral_key,
    {SCORES} FROM props0)"""
    emitted = "file_id, agent_ord, line_start, rule_ord"
    decided = (
        "SELECT file_id, decision, winning_agent, round(confidence, 9) AS confidence,"
        " coalesce(n_keys, 0) AS n_keys{0} FROM decided0"
    )
    valid = """, CASE WHEN decision = 'accept_changes' THEN round(confidence, 12) >= 0.6::DOUBLE
      WHEN decision = 'reject_changes' THEN round(confidence, 12) >= 0.5 ELSE true END AS valid"""
    averages = " || '|' || ".join(f"printf('%.6f', a_{a})" for a in AGENTS)
    gate = "b.confidence >= 0.6::DOUBLE"
    suffix = "reverse(split_part(reverse(path), '.', 1))"
    return {
        "code_corpus": corpus("SELECT file_id, path, code FROM corpus"),
        "invalid_targets": corpus(f"""SELECT DISTINCT t AS target_path, 'INVALID_PATH' AS code,
  'Invalid target path: ' || t AS message
  FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '/gone' || doc_id || '.py'
    ELSE {path_of('doc_id')} END AS t FROM documents) WHERE t NOT IN (SELECT path FROM corpus)"""),
        "unknown_agents": with_([REQUESTS], f"""SELECT agent_id, 'AGENT_NOT_FOUND' AS code,
  count(*) AS n_requests FROM requests WHERE agent_id NOT IN {AGENTS!r} GROUP BY agent_id"""),
        "language_mix": corpus(f"""SELECT CASE WHEN NOT contains(path, '.') THEN 'unknown'
    ELSE CASE {suffix} WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript'
    WHEN 'rb' THEN 'ruby' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' ELSE 'unknown' END END AS language,
  count(*) AS n_files, sum(length(code))::BIGINT AS n_chars FROM corpus GROUP BY 1"""),
        "python_files": corpus("SELECT file_id, path FROM corpus WHERE path LIKE '%.py'"),
        "active_agents": with_([REQUESTS], """SELECT r.agent_id,
  CASE WHEN p.on_ IS NULL THEN 'unknown' WHEN NOT p.on_ THEN 'disabled' ELSE 'active' END AS state,
  coalesce(p.pr, 5)::BIGINT AS priority, coalesce(p.th, 0.5)::DOUBLE AS confidence_threshold,
  count(*) AS n_requests FROM requests r LEFT JOIN (VALUES ('pattern_optimizer', 7, 0.6, true),
    ('security_enforcer', 9, 0.8, true), ('loop_simplifier', 6, 0.7, true),
    ('performance_optimizer', 5, 0.5, false), ('readability_enhancer', 4, 0.4, false))
    p(agent_id, pr, th, on_) ON p.agent_id = r.agent_id GROUP BY ALL"""),
        "active_agents_overridden": with_([REQUESTS, """own AS (SELECT ['pattern_optimizer', 'loop_simplifier',
    'performance_optimizer', 'style_fixer', 'security_enforcer', 'readability_enhancer', 'type_annotator'][k + 1] AS agent_id,
    CASE WHEN k % 2 = 0 THEN k + 1 END AS pr, CASE WHEN k % 3 = 0 THEN k / 10 END AS th,
    CASE WHEN k % 4 <> 1 THEN k % 4 = 2 END AS on_ FROM (SELECT n_nationkey AS k FROM nation) WHERE k < 7)""",
            """known(agent_id, pr, th, on_) AS (VALUES ('pattern_optimizer', 7, 0.6, true),
    ('security_enforcer', 9, 0.8, true), ('loop_simplifier', 6, 0.7, true),
    ('performance_optimizer', 5, 0.5, false), ('readability_enhancer', 4, 0.4, false))""",
            """p AS (SELECT coalesce(k.agent_id, o.agent_id) AS agent_id, coalesce(o.pr, k.pr, 5) AS pr,
    coalesce(o.th, k.th, 0.5) AS th, coalesce(o.on_, k.on_, true) AS on_ FROM known k FULL JOIN own o ON o.agent_id = k.agent_id)"""],
            f"""SELECT r.agent_id, CASE WHEN p.on_ IS NULL THEN 'unknown' WHEN NOT p.on_ THEN 'disabled'
    WHEN r.agent_id NOT IN {AGENTS!r} THEN 'no_implementation' ELSE 'active' END AS state,
  coalesce(p.pr, 5)::BIGINT AS priority, round(coalesce(p.th, 0.5)::DOUBLE, 9) AS confidence_threshold,
  count(*) AS n_requests FROM requests r LEFT JOIN p ON p.agent_id = r.agent_id GROUP BY ALL"""),
        "rule_pack_merge": f"""SELECT agent_id, CASE WHEN b THEN 'builtin' ELSE module END AS module,
  b AS shadowed_by_builtin, n_entries FROM (
    SELECT agent_id, arg_max(module, seq) AS module, count(*) AS n_entries,
      agent_id IN {AGENTS!r} AS b FROM (SELECT CASE WHEN event_id % 10 = 0
        THEN {pick(AGENTS, 'event_id')} ELSE 'plugin_' || (event_id % 25) END AS agent_id,
        'pkg_' || user_id || ':Agent' AS module, event_id AS seq FROM events) GROUP BY agent_id)""",
        "session_upsert": sessions(f"SELECT {CURRENT_ROW} FROM current"),
        "session_json_roundtrip": sessions(f"SELECT {CURRENT_ROW} FROM current"),
        "session_lookup": sessions(
            f"SELECT {CURRENT_ROW} FROM current WHERE refactor_id IN (FROM wanted)", WANTED),
        "session_not_found": sessions("""SELECT refactor_id, 'SESSION_NOT_FOUND' AS code,
  'Session not found: ' || refactor_id AS message FROM wanted
  WHERE refactor_id NOT IN (SELECT refactor_id FROM current)""", WANTED),
        "session_catalog": sessions("""SELECT DISTINCT refactor_id FROM versions
  WHERE regexp_full_match(refactor_id, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}')"""),
        "active_sessions": sessions(f"""SELECT refactor_id, target_path, status,
  {TIME.format('started_at')} AS started_at FROM current
  WHERE status IN ('started', 'in_progress')"""),
        "session_cancelled_versions": sessions("""SELECT refactor_id, target_path, '2024-02-15 00:00:00.000000' AS ts,
  seq + 1 AS seq, 'cancelled' AS status, progress FROM current WHERE refactor_id IN (FROM wanted)""", WANTED),
        "session_cancel": sessions("""SELECT w.refactor_id, c.status IS NOT NULL AS cancelled,
  c.status AS previous_status, CASE WHEN c.status IS NOT NULL THEN '2024-02-15 00:00:00.000000' END AS completed_at FROM wanted w LEFT JOIN current c USING (refactor_id)""", WANTED),
        "session_delete": sessions(f"""SELECT refactor_id, target_path, {TIME.format('ts')} AS ts, seq,
  status, progress FROM versions WHERE refactor_id NOT IN (FROM dropped)""", DROPPED),
        "session_status": sessions(f"""SELECT c.refactor_id, c.status, c.progress,
  coalesce(n, 0) AS current_iteration, {TIME.format('c.started_at')} AS last_update
  FROM current c LEFT JOIN (SELECT refactor_id, count(*) AS n FROM steps GROUP BY refactor_id) s
  USING (refactor_id)""", STEPS),
        "step_log_append": steps(f"SELECT {STEP_ROW} FROM steps"),
        "step_history": steps(f"SELECT {STEP_ROW} FROM steps"),
        "step_records": on_round(f"""SELECT file_id, 0::BIGINT AS iteration, agent_id AS agent, change_type,
  confidence, description, '@@ -' || line_start || ',' || line_end || ' +' || line_start || ',' ||
  line_end || ' @@' || {NL} || '-' || original_code || {NL} || '+' || modified_code AS code_diff
  FROM best0"""),
        "snapshot_sample": corpus(f"""SELECT r || '_iter_' || it || '.py' AS name,
  '# Snapshot - Session: ' || r || ', Iteration: ' || it || {NL} || '# Generated: '
  || strftime(TIMESTAMP '2024-02-15' + to_seconds(file_id), '%Y-%m-%dT%H:%M:%S.%f') || {NL} || {NL}
  || code AS content FROM (SELECT *, {SESSION.format('file_id')} AS r, file_id % 11 AS it FROM corpus)
  WHERE it % 5 = 0"""),
        "snapshot_list": steps("""SELECT refactor_id, name,
  CASE WHEN name LIKE '%x.py' THEN 0 ELSE iteration END AS iteration FROM snapshots""", SNAPSHOTS),
        "snapshot_retention": steps(f"""SELECT refactor_id, name, iteration,
  {TIME.format('mtime')} AS mtime FROM (SELECT * FROM snapshots WHERE mtime >= {CUTOFF}
  ORDER BY mtime DESC, name DESC LIMIT 100)""", SNAPSHOTS),
        "snapshot_retention_per_session": steps(f"""SELECT refactor_id, name, iteration,
  {TIME.format('mtime')} AS mtime FROM snapshots WHERE mtime >= {CUTOFF} QUALIFY row_number()
  OVER (PARTITION BY refactor_id ORDER BY mtime DESC, name DESC) <= 3""", SNAPSHOTS),
        "session_purge": steps("""SELECT refactor_id, name FROM snapshots
  WHERE refactor_id NOT IN (FROM dropped)""", SNAPSHOTS, DROPPED),
        "apply_plan": _fixpoint(10, """SELECT path, b AS content, path || '.backup' AS backup_path FROM pair
  WHERE file_id % 11 <> 0 AND file_id % 5 <> 0 AND b <> ''"""),
        "apply_backups": _fixpoint(10, """SELECT path || '.backup' AS path, a AS content FROM pair
  WHERE file_id % 11 <> 0 AND file_id % 5 <> 0 AND b <> ''"""),
        "apply_drift": _fixpoint(10, """SELECT path, 'modified' AS state FROM pair
  WHERE file_id % 11 <> 0 AND file_id % 5 = 0"""),
        "session_records": _fixpoint(10, f"""SELECT {SESSION.format('file_id')} AS refactor_id, path AS target_path,
  CASE WHEN a IS NULL THEN 'failed' ELSE 'completed' END AS status, CASE WHEN a IS NULL THEN 0 ELSE 100 END::BIGINT AS progress,
  {q('|'.join(AGENTS))} AS agent_set, a AS original_code, b AS refactored_code, coalesce(p.n_steps, 0) AS n_steps,
  coalesce(d.n_decisions, 0) AS n_decisions, coalesce(edits, '') AS edits,
  CASE WHEN a IS NOT NULL THEN coalesce(lines_changed, 0) END AS lines_changed, {DELTA} AS complexity_delta,
  CASE WHEN a IS NOT NULL THEN {IMPROVEMENTS} END AS security_improvements,
  CASE WHEN a IS NOT NULL THEN round({GAINS}, 9) END AS performance_gains,
  CASE WHEN a IS NOT NULL THEN coalesce(shares, '') END AS agent_contributions,
  {TIME.format("TIMESTAMP '2024-01-01 00:00:00' + to_seconds(file_id)")} AS started_at,
  CASE WHEN a IS NOT NULL THEN '2024-02-15 00:00:00.000000' END AS completed_at,
  CASE WHEN a IS NULL THEN 'unreadable text' END AS error_message
  FROM pair LEFT JOIN applied p USING (file_id) LEFT JOIN shares USING (file_id) LEFT JOIN in_order USING (file_id)
  JOIN done d USING (file_id)""", DAMAGED),
        "result_report": _fixpoint(10, f"""SELECT file_id, path, coalesce(n_steps, 0) AS n_steps,
  coalesce(changes, '') AS changes,
  {DELTA} AS complexity_delta, {IMPROVEMENTS} AS security_improvements,
  round({GAINS}, 9) AS performance_gains, coalesce(lines_changed, 0) AS lines_changed, 'completed' AS status,
  coalesce(agents, '') AS agents, n_decisions
  FROM pair LEFT JOIN applied USING (file_id) LEFT JOIN in_order USING (file_id) JOIN (SELECT file_id, n_decisions FROM done) USING (file_id)"""),
        "numbered_listing": with_([CORPUS, *lines_ctes("0", "corpus")[:1]], f"""SELECT file_id,
  any_value(path) AS path, string_agg(printf('%4d: %s', i + 1, line), {NL} ORDER BY i) AS listing
  FROM ctx0 JOIN corpus USING (file_id) GROUP BY file_id"""),
        "code_lines": on_lines("SELECT file_id, i AS line_no, line FROM ctx0"),
        "line_context": on_lines(
            "SELECT file_id, i AS line_no, line, n1 AS next1, n2 AS next2, n3 AS next3 FROM ctx0"),
        "line_indent": on_lines("SELECT file_id, i AS line_no, ind AS indent FROM ctx0"),
        "block_end": on_lines(f"""SELECT s.file_id, s.i AS line_no,
  coalesce(min(l.i), any_value(s.n)) - 1 AS end_line
  FROM (SELECT * FROM ctx0 WHERE {matches('line', WHILE)}) s
  LEFT JOIN ctx0 l ON l.file_id = s.file_id AND l.i > s.i AND l.ind <= s.ind AND NOT l.blank
  GROUP BY s.file_id, s.i"""),
        "nested_loop_sites": on_lines("SELECT file_id, i AS line_no FROM site0"),
        "loop_counts": corpus(f"SELECT file_id, {LOOPS} AS n_loops FROM corpus"),
        "vuln_counts": on_vulns(
            "SELECT file_id, rule_id, category, len(m) AS n_matches FROM vuln WHERE len(m) > 0"),
        "vuln_by_category": on_vulns("""SELECT category, rule_id, count(*) AS n_files,
  sum(len(m))::BIGINT AS n_matches FROM vuln WHERE len(m) > 0 GROUP BY category, rule_id"""),
        "vuln_matches": on_vulns("""SELECT file_id, rule_id, label, unnest(range(len(m))) AS match_no,
  unnest(m) AS matched FROM vuln"""),
        "top_risky_files": on_vulns("""SELECT file_id, sum(len(m))::BIGINT AS n_matches FROM vuln
  GROUP BY file_id ORDER BY n_matches DESC, file_id LIMIT 20"""),
        "detect_pattern_issues": with_(
            [CORPUS, *lines_ctes("0", "corpus")[:1], PATTERN_CTE], "FROM pattern_issue"),
        "detect_loop_issues": with_([CORPUS, LOOP_CTE], "FROM loop_issue"),
        "unsafe_rewrites": on_props(f"""SELECT file_id, rule_id, line_start FROM props0 WHERE
  {matches('modified_code', r'eval\(|exec\(|os\.system\(|shell\s*=\s*True|pickle\.loads\(')}"""),
        "finding_counts": _analysis([CORPUS], "FROM found"),
        "analysis_counts": _analysis(DAMAGED, """SELECT file_id, agent_id,
  CASE WHEN NOT bad THEN issues_found WHEN agent_id <> 'security_enforcer' THEN 0 END AS issues_found,
  CASE WHEN NOT bad THEN confidence WHEN agent_id <> 'security_enforcer' THEN 0 END AS confidence,
  CASE WHEN bad AND agent_id = 'security_enforcer' THEN 'SYNTAX_ERROR' END AS error
  FROM found JOIN (SELECT file_id, file_id % 31 = 3 OR code IS NULL AS bad FROM corpus) USING (file_id)"""),
        "failed_files": with_(DAMAGED, """SELECT file_id, path, 'unreadable text' AS error_message
  FROM corpus WHERE code IS NULL"""),
        "propose_security": on_props(
            f"SELECT {PROP_COLUMNS} FROM props0 WHERE agent_id = 'security_enforcer'"),
        "propose_pattern": on_props(
            f"SELECT {PROP_COLUMNS} FROM props0 WHERE agent_id = 'pattern_optimizer'"),
        "propose_loop": on_props(
            f"SELECT {PROP_COLUMNS} FROM props0 WHERE agent_id = 'loop_simplifier'"),
        "all_proposals": on_props(f"SELECT {PROPS_ALL} FROM props0"),
        "proposals_by_type": on_props("""SELECT agent_id, change_type, rule_id,
  count(*) AS n_proposals, round(sum(impact_score), 9) AS impact FROM props0 GROUP BY ALL"""),
        "user_rule_proposals": with_(
            [CORPUS, *lines_ctes("0", "corpus")[:1],
             "lang_code AS (SELECT DISTINCT lang FROM documents)"],
            f"""SELECT c.file_id, 'U_' || lang AS rule_id, c.i AS line_start,
  regexp_replace(line, lang || ' [a-z]', upper(lang) || ' ', 'g') AS modified_code,
  0.5::DOUBLE AS confidence FROM ctx0 c, lang_code
  WHERE regexp_matches(line, lang || ' [a-z]')"""),
        "user_rule_counts": with_(
            [CORPUS, "lang_code AS (SELECT DISTINCT lang FROM documents)"],
            """SELECT * FROM (SELECT file_id, 'U_' || lang AS rule_id, 'language_code' AS category,
  len(regexp_extract_all(code, lang || ' [a-z]')) AS n_matches FROM corpus, lang_code)
  WHERE n_matches > 0"""),
        "votes_security": _votes("security_enforcer"),
        "votes_pattern": _votes("pattern_optimizer"),
        "votes_loop": _votes("loop_simplifier"),
        "collect_votes": with_([CORPUS, *proposal_ctes("0", "corpus"), voted],
                               _ballots("voted", emitted)),
        "collect_votes_failed": with_([CORPUS, *proposal_ctes("0", "corpus"), voted],
                                      _ballots("voted", emitted, "loop_simplifier")),
        "vote_dedup": on_votes(_ballots("scored0", "file_id")),
        "key_scores": on_votes(
            "SELECT file_id, vote_key, round(key_score, 9) AS key_score FROM scored0"),
        "consensus": on_votes(decided.format("")),
        "consensus_winner": on_votes(
            f"SELECT file_id, winning_agent, {averages} AS voter_averages FROM decided0"),
        "priority_override": _override(),
        "validated_decisions": on_votes(decided.format(valid)),
        "consensus_weighted": on_votes(decided.format(""), weights=(7 / 22, 9 / 22, 6 / 22)),
        "meaningful_changes": on_round(f"SELECT {PROPS_ALL} FROM useful0"),
        "best_change": on_round(f"SELECT {PROPS_ALL} FROM best0"),
        "gated_change": on_round(f"""SELECT b.file_id, b.rule_id, b.line_start, b.confidence, d.decision,
  d.winning_agent, round(d.confidence, 9) AS vote_confidence
  FROM best0 b JOIN decided0 d USING (file_id) WHERE {gate}"""),
        "apply_best": on_round("SELECT file_id, b AS refactored_code, applied FROM pair"),
        "apply_mismatch": on_round(f"""SELECT file_id, rule_id, line_start,
  {strip('original_code')} AS expected, {strip('line')} AS found FROM best0 b
  WHERE {gate} AND NOT fits"""),
        "refactor_fixpoint": _fixpoint(10, "FROM done"),
        "refactor_with_user_rules": _fixpoint(10, """SELECT file_id, coalesce(user_steps, 0) AS user_steps, refactored_code,
  done.n_steps, n_decisions, rounds, reason FROM done LEFT JOIN applied USING (file_id)""", [CORPUS, USER_RULES], user=True),
        "convergence_report": _fixpoint(10, """SELECT reason, rounds, count(*) AS n_files,
  sum(n_steps)::BIGINT AS n_steps FROM done GROUP BY reason, rounds"""),
        "validate_security": _fixpoint(10, f"""SELECT file_id, ({_vuln_total('b')} <= {_vuln_total('a')})
  AND NOT (contains(a, 'eval(') AND contains(b, 'eval('))
  AND NOT (contains(a, 'exec(') AND contains(b, 'exec('))
  AND NOT (contains(a, 'os.system(') AND contains(b, 'os.system(')) AS valid FROM pair"""),
        "complexity": corpus(
            f"SELECT file_id, round({complexity('code')}, 9) AS complexity FROM corpus"),
        "complexity_delta": _fixpoint(10, f"SELECT file_id, {DELTA} AS complexity_delta FROM pair"),
        "security_improvements": _fixpoint(
            10, f"SELECT file_id, {IMPROVEMENTS} AS security_improvements FROM pair"),
        "performance_gains": _fixpoint(
            10, f"SELECT file_id, round({GAINS}, 9) AS performance_gains FROM pair"),
        "lines_changed_multiset": _fixpoint(10, "FROM changed"),
        "lines_changed_exact": _fixpoint(10, """SELECT file_id, coalesce(lines_changed, 0) AS lines_changed
  FROM pair LEFT JOIN in_order USING (file_id)"""),
        "refactor_metrics": _fixpoint(10, f"""SELECT file_id, coalesce(lines_changed, 0) AS lines_changed,
  {DELTA} AS complexity_delta, {IMPROVEMENTS} AS security_improvements,
  round({GAINS}, 9) AS performance_gains FROM pair LEFT JOIN in_order USING (file_id)"""),
        "agent_contributions": steps("""SELECT refactor_id,
  string_agg(agent || '=' || n, '|' ORDER BY agent) AS agent_contributions
  FROM (SELECT refactor_id, agent, count(*) AS n FROM steps GROUP BY ALL) GROUP BY refactor_id"""),
        "session_totals": _fixpoint(10, """SELECT count(DISTINCT CASE WHEN event_id % 50 = 0 THEN 'bad-' || user_id
    ELSE user_id::VARCHAR END)::BIGINT AS sessions_total,
  (SELECT sum(n_decisions) FROM done)::BIGINT AS consensus_rounds_total FROM events"""),
        "active_gauge": sessions(f"""SELECT {TIME.format('ts')} AS ts, seq, change,
  (sum(change) OVER (ORDER BY ts, seq))::BIGINT AS active FROM (SELECT ts, seq,
    (CASE status WHEN 'started' THEN 1 ELSE -1 END)::BIGINT AS change FROM versions
    WHERE status <> 'in_progress')"""),
        "latency_histogram": _histogram(),
        "stream_scan": with_(
            [CORPUS, "py AS (SELECT * FROM corpus WHERE path LIKE '%.py')", vuln_cte("py")],
            "SELECT file_id, rule_id, category, len(m) AS n_matches FROM vuln WHERE len(m) > 0"),
        "stream_step_counts": f"""SELECT {TIME.format("date_trunc('day', ts)")} AS day,
  {pick(AGENTS, 'event_id')} AS agent, {pick(KINDS, 'event_id')} AS change_type,
  count(*) AS n_steps FROM events GROUP BY ALL""",
        "stream_session_status": sessions(
            f"SELECT refactor_id, {TIME.format('ts')} AS ts, status, progress FROM current"),
        "stream_active_gauge": sessions(f"""SELECT {TIME.format('day')} AS day, change,
  (sum(change) OVER (ORDER BY day))::BIGINT AS active FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day,
    sum(CASE status WHEN 'started' THEN 1 WHEN 'in_progress' THEN 0 ELSE -1 END)::BIGINT AS change
    FROM versions GROUP BY 1)"""),
        "progress_timeline": _fixpoint(10, """SELECT file_id, k AS iteration,
  floor(k / 10.0 * 100)::BIGINT AS progress
  FROM (SELECT file_id, unnest(range(rounds)) AS k FROM done)"""),
    }
