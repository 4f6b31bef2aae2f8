"""Code corpus and session tables derived from the given tables by plain projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.config import AGENTS, CHANGE_TYPES
from corpusaudit.operators.ranking import ordinal_in_group
from corpusaudit.sources.files import spread

# The code snippets mixed into the documents.
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
EXTENSIONS = (".py", ".py", ".py", ".js", ".go", ".rb", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def as_code(documents: DataFrame) -> DataFrame:
    """(file_id, path, code): the text as comment lines, then three snippets chosen by id."""
    doc_id = F.col("doc_id")
    comment = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    code = F.concat_ws(
        "\n",
        comment,
        _pick(SNIPPETS, doc_id),
        _pick(SNIPPETS, doc_id * 2 + 5),
        _pick(SNIPPETS, doc_id * 3 + 10),
    )
    path = F.concat("source", F.lit("/m"), doc_id.cast("string"), _pick(EXTENSIONS, doc_id))
    return documents.select(doc_id.alias("file_id"), path.alias("path"), code.alias("code"))


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return as_code(spread(docs))


def damaged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with broken, empty and unreadable texts among the others."""
    file_id = F.col("file_id")
    code = (
        F.when(file_id % 31 == 3, F.concat(F.lit("def invalid syntax here +++\n"), "code"))
        .when(file_id % 37 == 5, "")
        .when(file_id % 41 != 7, F.col("code"))
    )
    return code_corpus(spark, sf_dir).withColumn("code", code)


def profile_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that users write over the known profiles; null where they leave one as it is."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).filter("k < 7")
    return nations.select(
        _pick(
            ("pattern_optimizer", "loop_simplifier", "performance_optimizer", "style_fixer", "security_enforcer", "readability_enhancer", "type_annotator"),
            F.col("k"),
        ).alias("agent_id"),
        F.when(F.col("k") % 2 == 0, F.col("k") + 1).cast("int").alias("priority"),
        F.when(F.col("k") % 3 == 0, F.col("k") / 10).alias("confidence_threshold"),
        F.when(F.col("k") % 4 != 1, F.col("k") % 4 == 2).alias("enabled"),
    )


def session_key(user_id: Column) -> Column:
    """A UUID-shaped session id."""
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(user_id.cast("string"), 12, "0"))


def as_session_versions(events: DataFrame) -> DataFrame:
    """Versions of refactoring sessions, one per event."""
    refactor_id = F.when(
        F.col("event_id") % 50 == 0, F.concat(F.lit("bad-"), F.col("user_id").cast("string"))
    ).otherwise(session_key(F.col("user_id")))
    status = (
        F.when(F.col("event_type") == "signup", "started")
        .when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("in_progress")
    )
    return events.select(
        refactor_id.alias("refactor_id"),
        F.concat(F.lit("src/m"), F.col("user_id").cast("string"), F.lit(".py")).alias("target_path"),
        "ts",
        F.col("event_id").alias("seq"),
        status.alias("status"),
        (F.floor("value") % 101).cast("long").alias("progress"),
    )


def session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_session_versions(table(spark, sf_dir, "events"))


def agent_of(event_id: Column) -> Column:
    return _pick(AGENTS, event_id)


def change_type_of(event_id: Column) -> Column:
    return _pick(CHANGE_TYPES, event_id)


def _step_columns() -> list[Column]:
    return [
        session_key(F.col("user_id")).alias("refactor_id"),
        agent_of(F.col("event_id")).alias("agent"),
        change_type_of(F.col("event_id")).alias("change_type"),
        (F.col("event_id") % 100 / 100.0).alias("confidence"),
        "ts",
    ]


def unnumbered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied steps of every session, for whatever does not ask for their number."""
    return table(spark, sf_dir, "events").select(*_step_columns())


def as_steps(events: DataFrame) -> DataFrame:
    """Applied steps of every session, numbered in time order."""
    numbered = ordinal_in_group(
        events.select("user_id", "ts", "event_id"),
        key="user_id",
        order=("ts", "event_id"),
        name="iteration",
    )
    return numbered.select(*_step_columns(), "iteration")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_steps(table(spark, sf_dir, "events"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        agent_of(F.col("event_id")).alias("agent"), (F.col("value") / 100).alias("seconds")
    )


def snapshots(spark: SparkSession, sf_dir: str, every: int = 5) -> DataFrame:
    """Snapshot listing: every ``every``-th step of a session; some names carry no number."""
    kept = steps(spark, sf_dir).filter(F.col("iteration") % every == 0)
    damaged = F.when(F.col("iteration") % 20 == 15, "x").otherwise("")
    name = F.concat(
        "refactor_id", F.lit("_iter_"), F.col("iteration").cast("string"), damaged, F.lit(".py")
    )
    return kept.select("refactor_id", name.alias("name"), "iteration", F.col("ts").alias("mtime"))


def target_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that users ask to refactor; a third of them does not exist."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    doc_id = F.col("doc_id")
    there = F.concat("source", F.lit("/m"), doc_id.cast("string"), _pick(EXTENSIONS, doc_id))
    gone = F.concat("source", F.lit("/gone"), doc_id.cast("string"), F.lit(".py"))
    return docs.select(F.when(doc_id % 3 == 0, gone).otherwise(there).alias("target_path"))


def agent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agents that every event's session asks for."""
    event_id = F.col("event_id")
    second = _pick(
        (
            "pattern_optimizer",
            "security_enforcer",
            "loop_simplifier",
            "performance_optimizer",
            "readability_enhancer",
            "style_fixer",
            "type_annotator",
        ),
        event_id,
    )
    events = table(spark, sf_dir, "events").select("event_id")
    return events.select(F.array(agent_of(event_id), second).alias("agent_set"))


def agent_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent entries registered by users; every tenth one takes the id of a built-in agent."""
    event_id = F.col("event_id")
    plugin = F.concat(F.lit("plugin_"), (event_id % 25).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.when(event_id % 10 == 0, agent_of(event_id)).otherwise(plugin).alias("agent_id"),
        F.concat(F.lit("pkg_"), F.col("user_id").cast("string"), F.lit(":Agent")).alias("module"),
        event_id.alias("seq"),
    )


def wanted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that customers ask for; most of them were never started."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.select(session_key(F.col("c_custkey")).alias("refactor_id"))


def dropped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that suppliers ask to delete."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    return suppliers.select(session_key(F.col("s_suppkey")).alias("refactor_id"))


def round_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an iteration and a time, as they are offered for snapshots."""
    start = F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")
    file_id = F.col("file_id")
    return code_corpus(spark, sf_dir).select(
        session_key(file_id).alias("refactor_id"),
        (file_id % 11).alias("iteration"),
        "code",
        (start + F.make_dt_interval(secs=file_id)).alias("ts"),
    )


def edited_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after someone else touched every fifth file."""
    touched = F.when(F.col("file_id") % 5 == 0, F.concat("code", F.lit("\n# touched")))
    return code_corpus(spark, sf_dir).withColumn("code", F.coalesce(touched, "code"))


def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table made of the languages in the corpus: their code before a word is written in
    capitals and takes the word's first letter with it."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    return langs.select(
        F.concat(F.lit("U_"), "lang").alias("rule_id"),
        F.lit("language_code").alias("category"),
        F.concat("lang", F.lit(" [a-z]")).alias("pattern"),
        F.concat(F.upper("lang"), F.lit(" ")).alias("replacement"),
        F.lit(0.5).alias("confidence"),
        F.lit(0.1).alias("impact"),
        F.lit("readability").alias("change_type"),
    )


def loop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that user agents iterate: names in the code become longer ones, and comment marks of
    the languages in the corpus get a colon."""
    words = spark.createDataFrame(
        [
            ("U_item", r"\btemp_value\b", "item_twice", 0.9),
            ("U_grid", r"\bin matrix:", "in grid:", 0.75),
            ("U_vals", r"for v in vals", "for value in values", 0.65),
            ("U_load", r"pickle\.loads\((\w+)\)", r"json.loads(\1)", 0.95),
        ],
        "rule_id string, pattern string, replacement string, confidence double",
    )
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    marks = langs.select(
        F.concat(F.lit("U_"), "lang").alias("rule_id"),
        F.concat(F.lit("^# "), "lang", F.lit(" ")).alias("pattern"),
        F.concat(F.lit("# "), "lang", F.lit(": ")).alias("replacement"),
        F.lit(0.7).alias("confidence"),
    )
    return words.unionByName(marks).select(
        "rule_id", F.lit("naming").alias("category"), "pattern", "replacement", "confidence",
        F.lit(0.1).alias("impact"), F.lit("readability").alias("change_type"),
    )
