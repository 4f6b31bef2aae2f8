"""User agents in the fix-point: their rules propose, vote, apply and iterate with the built-in ones."""

import re

import pytest

from corpusaudit.config import AuditConfig
from corpusaudit.operators.rulepack import RULE_COLUMNS
from corpusaudit.operators.useragents import MOST_RULES, UserAgent
from corpusaudit.plans.refactor import refactor
from tests import fuzz


def agent(*rules, name="mine", vote=lambda field: field("confidence")):
    return UserAgent(name, tuple((f"U{i}", "naming", p, r, c, 0.1, "readability") for i, (p, r, c) in enumerate(rules)), vote)


def test_rules_iterate_and_follow_each_other(corpus_of):
    chain = agent((r"\bstep1\b", "step2", 0.9), (r"\bstep2\b", "step3", 0.8), (r"(\w+) = old", r"\1 = new", 0.7))
    rows = refactor(corpus_of("step1()\nx = old\nstep1()", "nothing", "", None), agents=[chain]).collect()
    r = {x.file_id: x for x in rows}
    assert r[0].refactored_code == "step3()\nx = new\nstep3()" and r[0].reason == "no_changes" and r[0].lines_changed == 6
    assert [s.modified_code for s in r[0].steps] == ["step2()", "step2()", "step3()", "step3()", "x = new"]
    assert {s.agent for s in r[0].steps} == {"mine"}
    assert [len(r[i].steps) for i in (1, 2)] == [0, 0]


def test_user_and_built_in_edits_compete(corpus_of):
    code = 'password = "hunter2_longpass"\nname1 = 1'
    strong, weak = agent((r"\bname1\b", "name2", 0.95)), agent((r"\bname1\b", "name2", 0.7))
    first = {k: refactor(corpus_of(code), agents=[a]).first().steps[0].agent for k, a in (("strong", strong), ("weak", weak))}
    assert first == {"strong": "mine", "weak": "security_enforcer"}
    below = refactor(corpus_of("name1 = 1"), agents=[agent((r"\bname1\b", "name2", 0.5))]).first()
    assert below.refactored_code == "name1 = 1" and below.reason == "max_iterations"


def test_user_voters_count(corpus_of):
    edit = (r"\bname1\b", "name2", 0.9)
    cfg = AuditConfig(gate="consensus", max_iterations=1)
    for score, decision in ((1.0, "accept_changes"), (0.0, "reject_changes")):
        from pyspark.sql import functions as F

        r = refactor(corpus_of("name1"), cfg, [agent(edit, vote=lambda f, s=score: F.lit(s))]).first()
        average = (0.9 * 0.8 + 0.9 * 0.7 + 0.9 * 0.6 + score) / 4
        assert r.decisions[0].decision == decision == ("accept_changes" if average >= 0.6 else "reject_changes")
        assert r.refactored_code == ("name2" if average >= 0.6 else "name1")
    two = [agent(edit), agent((r"name2", "name3", 0.8), name="other")]
    assert refactor(corpus_of("name1"), agents=two).first().refactored_code == "name3"


def test_equals_a_plain_loop_on_random_texts(corpus_of):
    """With one rule per line and no built-in agent, the loop applies the strongest edit of the first line that has one."""
    rules = [(r"\bitem\b", "thing", 0.9), (r"return (\w+)", r"return (\1)", 0.8), (r"\bxs\b", "values", 0.7)]
    texts = fuzz.texts(300, seed=77)
    got = {r.file_id: (r.refactored_code, len(r.steps)) for r in refactor(corpus_of(*texts), AuditConfig(agent_set=("loop_simplifier",), max_iterations=4), [agent(*rules)]).collect()}
    plain = {r.file_id: r.refactored_code for r in refactor(corpus_of(*texts), AuditConfig(agent_set=("loop_simplifier",), max_iterations=4)).collect()}
    checked = 0
    for i, text in enumerate(texts):
        if plain[i] != text:
            continue  # built-in edits take part
        lines, steps = text.split("\n"), 0
        for _ in range(4):
            best = min(
                ((-c, n, k, re.sub(p, r, line)) for n, line in enumerate(lines) for k, (p, r, c) in enumerate(rules) if re.search(p, line)
                 and re.sub(p, r, line).strip() != line.strip()),
                default=None,
            )
            if best is None:
                break
            lines[best[1]] = best[3]
            steps += 1
        if got[i] == ("\n".join(lines), steps):
            checked += 1
        else:  # a built-in edit that cannot be applied may be the best one
            assert got[i][1] <= steps
    assert checked > 60


def test_agents_are_checked(spark, corpus_of):
    files = corpus_of("x")
    for wrong in ([agent(name="loop_simplifier")], [agent(), agent()], [agent(*[("x", "y", 0.5)] * (MOST_RULES + 1))]):
        with pytest.raises(ValueError):
            refactor(files, agents=wrong)
    with pytest.raises(ValueError, match="not unique"):
        refactor(files, agents=[UserAgent("a", (("U", "c", "x", "y", 0.5, 0.1, "readability"),) * 2, lambda f: f("confidence"))])
    with pytest.raises(ValueError):
        refactor(files, agents=[agent(("(?x) a", "b", 0.5))])
    table = spark.createDataFrame([("U1", "c", "x", "y", 0.9, 0.1, "readability")], "rule_id string, category string, pattern string, replacement string, confidence double, impact double, change_type string")
    mine = UserAgent.from_table("mine", table.select(*reversed(RULE_COLUMNS)), lambda f: f("confidence"))
    assert refactor(files, agents=[mine]).first().refactored_code == "y"


def test_a_text_is_folded_once_for_all_rules(spark):
    """Before, the text and each line were folded again for every rule, and patterns compiled for every line."""
    from pyspark.sql import functions as F

    from corpusaudit.operators.useragents import active_rules, rules_array, user_edits

    files = spark.createDataFrame([(["a name1", "b"],)], "lines array<string>")
    mine = rules_array([agent((r"name1", "name2", 0.9), (r"[a-z]x", "y", 0.9))], 0)
    active = files.select("lines", active_rules(mine, F.col("lines")).alias("active"))
    edits = files.select(user_edits(active_rules(mine, F.col("lines")), F.get("lines", F.lit(0)), F.lit(0)).alias("edits"))
    assert [r.modified_code for r in edits.first().edits] == ["a name2"]
    assert [r.rule_id for r in active.first().active] == ["U0", "U1"]
    plans = [df._jdf.queryExecution().analyzed().toString().lower() for df in (active, edits)]
    assert not any("contains(lower(" in plan for plan in plans)  # rules are tested on a text that is folded already
    assert "rlike" not in plans[1]
