"""Random source texts that are dense in what the rules look for."""

from __future__ import annotations

import random

NAMES = ["x", "xs", "item", "größe", "n1", "_t", "data"]
LINES = [
    "for {a} in {b}:",
    "for {a} in {b} + 1: pass",
    "for  {a}  in  range(len({b})):",
    "for {a} in range(len({b})):",
    "if {a} > 0:",
    "if {a} in {b}:",
    "{a} = {b}[{c}]",
    "{a}.append({b})",
    "{a}.append({b} * 2)",
    "self.{a}.append(({b}, {c}))",
    ".append()",
    "return {a}",
    "return",
    "else:",
    "{a} = 0",
    "{a} += {b}",
    "{a} += 1",
    "count = 0",
    "count += 1",
    "sum = 0",
    "sum += {a}",
    "while True:",
    "while  True: pass",
    "break",
    "if {a}: break",
    "temp_{a} = {b}",
    "tmp_{a}= 1",
    'password = "hunter2_longpass"',
    "my_password   =   'secret value'  # {a}",
    "PASSWORD = 'another one'",
    'password = os.environ["x"] or "long enough"',
    'api_key = "ABCDEFGHIJKLMNOPQ"',
    'api_key = "short"',
    'cursor.execute("select %s" % {a})',
    'cursor.execute("select ?", {a} % 2)',
    'cursor.execute("select %d %name",',
    "eval(input())",
    "exec(raw_input({a}))",
    "eval({a})",
    "h = hashlib.md5({a}) + hashlib.sha1({b})",
    "token = random.random()",
    "Secret = random.random( ) + random.random()",
    "open('../etc/{a}')",
    'p = "../../{a}"',
    "os.system('rm ' + {a})",
    "os.system({a})",
    "obj = pickle.loads({a})",
    "marshal.loads({a})",
    "subprocess.run({a} + {b}, shell=True)",
    "os.path.join({a}, '..')",
    'f"{{{a}}}" + execute({b} + {c})',
    "'{{}}'.format({a}).execute({b})",
    "ssl.PROTOCOL_SSLv3",
    "secret = 'abcdefghijklmnop'",
    'token = "abcdefghijklmnopqrstuvwxyz"',
    "paſſword = 'hunter2_longpass'",
    "def {a}({b}):",
    "try:",
    "except {a}:",
    "# for {a} in {b}:",
    "",
    "   ",
    " ",
    "{a}, {b} = yield",
    "enumerate({a})",
    "text with 'quote",
    ")",
    "if {a} > {b}:\n    return {a}\nelse:\n    return {b}",
    "if {a}: return {a}\nelse: return {c}",
    "if {a} in {b}:\n    {b}[{a}]",
    "if {a} in {b}:\n    {c} = {b}[{a}]",
    "count = 0\nfor {a} in {b}:\n    count += 1",
]


def texts(n: int, seed: int = 7, longest: int = 14) -> list[str]:
    rng = random.Random(seed)
    out = ["", " ", "\n", "\n\n"]
    while len(out) < n:
        lines = []
        depth = 0
        for _ in range(rng.randint(1, longest)):
            depth = max(0, depth + rng.choice([-1, 0, 0, 1, 1]))
            a, b, c = (rng.choice(NAMES) for _ in range(3))
            body = rng.choice(LINES).format(a=a, b=b, c=c)
            margin = rng.choice([" " * 4 * depth, " " * 4 * depth, "\t" * depth, "　" * depth])
            tail = rng.choice(["", "", "", " ", "\t", " "])
            lines.append(margin + body + tail)
        out.append("\n".join(lines))
    return out
