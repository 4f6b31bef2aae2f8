"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.llm import (
    alignment, ball_search, bpe, chat, exact, html, mixing, nndescent, quality, secret_scan, setsketch, simple8b, token_counts,
)
from corpusaudit.llm.store import table
from corpusaudit.sources.state import new_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.repetitions(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.mark_copies(table(spark, sf_dir, "documents"), keep="largest")
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(quality.remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.inline(F.array(*[
            F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text"))
            for i, r in enumerate(("user", "assistant"))
        ]))
    )
    out = chat.format_conversations(turns.unionByName(extra))
    back = chat.parse(F.col("formatted"))
    read = out.select("conv_id", "formatted", back.alias("turns"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    said_by = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said_by, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(table(spark, sf_dir, "documents"), VOCABULARY)


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_dir(spark, "tokens")
    simple8b.write_tokens(table(spark, sf_dir, "documents"), VOCABULARY, out, END_ID)
    return simple8b.read_tokens(spark, out)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = nndescent.build(nndescent.usable(table(spark, sf_dir, "embeddings")))
    return nndescent.search(index, index.queries("vec_id % 100 = 0"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_VOCABULARY).drop("groups")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE]
    held = found.select(
        F.col("row.doc_id").alias("doc_id"), "spans", F.filter("spans", lambda s: s["kind"].isin(base)).alias("base")
    )
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in base]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{k}") for k, n in zip(base, counts)]
    return held.select(
        "doc_id", *counts,
        F.sha2(secret_scan.rendered(F.col("base")), 256).alias("base_sha256"),
        secret_scan.rendered(F.col("spans")).alias("spans"),
    )


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_mix, op2_exact_dedup, op3_html_text, op4_quality, op5_chat_format, op6_bpe,
            op7_token_counts, op8_token_binary, op9_near_dedup, op10_nearest,
            op11_alignment, op12_lexical, op13_secrets,
        )
    }


SQL_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM sums
), ordered AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS pool,
    row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS nr FROM weighed
), levels AS (
  SELECT *, (pool - coalesce(sum(cap) OVER (ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered
), lvl AS (SELECT level FROM levels WHERE weight * level <= cap ORDER BY nr LIMIT 1
), targets AS (
  SELECT source, source_size, least(weight * lvl.level, cap)::DOUBLE AS target FROM levels, lvl
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""

SQL_EXACT = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

SQL_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length('<s>[INST] ' || role || ' [/INST]' || text || '</s>')
    + CASE WHEN regexp_matches(role || ' ' || text, '</s>|[<\[]\\+/(s>|INST\])') OR contains(role, ' [/INST]')
      THEN len(regexp_extract_all(role, '[<\[]\\*/(s>|INST\])')) + len(regexp_extract_all(text, '[<\[]\\*/(s>|INST\])'))
      ELSE 0 END AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def _rule_matches(rank: int, rule: secret_scan.Rule) -> str:
    quoted = "'" + rule.pattern.replace("'", "''") + "'"
    return (
        f"SELECT r, '{rule.kind}' AS kind, {rank} AS place, {rule.least} AS least, regexp_extract_all(text, {quoted}) AS ms,"
        f" regexp_extract_all(text, {quoted}, {rule.group}) AS tested, string_split_regex(text, {quoted}) AS gaps"
        f" FROM d WHERE regexp_matches(text, {quoted})"
    )


SQL_SECRETS = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  {" UNION ALL ".join(_rule_matches(i, rule) for i, rule in enumerate(secret_scan.RULES))}
), each AS (
  SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m
), s AS (
  SELECT r, kind, place, length(array_to_string(gaps[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS start_at, length(ms[i]) AS n
  FROM each WHERE length(tested[i]) >= least
), t AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start_at || ':' || (start_at + n), ',' ORDER BY start_at, place) FILTER (place < {len(secret_scan.BASE)}) AS base,
    string_agg(kind || ':' || start_at || ':' || (start_at + n), ',' ORDER BY start_at, place) AS spans
  FROM s GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (r)
"""


SQL_LEXICAL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark
), held AS (
  SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items
), sizes AS (
  SELECT r, count(*) AS n FROM held GROUP BY r
), corpus AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes
), tf AS (
  SELECT r, doc_id, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, term
), df AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY term, n_docs
), valued AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))) AS x
  FROM tf JOIN sizes USING (r), corpus
), scored AS (
  SELECT i, item_id, r, doc_id, sum(w * x)::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN valued USING (term) GROUP BY i, item_id, r, doc_id HAVING sum(w * x) > 0
), placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""


def statements() -> dict[str, str]:
    return {
        "op1_mix": SQL_MIX, "op2_exact_dedup": SQL_EXACT, "op5_chat_format": SQL_CHAT, "op12_lexical": SQL_LEXICAL,
        "op13_secrets": SQL_SECRETS,
    }
