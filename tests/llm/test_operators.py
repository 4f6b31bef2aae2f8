"""The operators on training data against brute force, and on nulls, empty and long texts, ties,
repeated rows, empty tables and columns with clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusaudit.llm import bpe, chat, components, exact, html, mixing, nndescent, quality, queries, setsketch, simple8b, token_counts

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and blank texts, ties, repeated rows, one very long text, and extra
    columns called like columns inside the operators."""
    long = " ".join(f"w{i % 997}x" for i in range(60_000))
    rows = [
        (1, "The cat  sat", "en", "a", 3), (1, "The cat  sat", "en", "a", 3), (2, "the CAT  sat", None, "a", None), (3, None, "en", None, 0),
        (4, "", "en", "", 0), (5, " \t\n", "en", "b", 3), (None, "no id here", "en", "b", 1), (None, None, None, None, None),
        (6, "É é É", "fr", "b", 5), (7, "é é é", "fr", "b", 5), (8, long, "en", "c", len(long)), (1, "another text of one", "en", "a", 1),
        (9, "<|endoftext|> it's 12 \U0001F600", "en", "c", 9),
    ]
    df = spark.createDataFrame([(*r, 7, "x", 0.5, [1], "h") for r in rows], SCHEMA + ", size int, row string, score double, ids array<int>, hash string")
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_targets_and_edges(spark, odd, none):
    rows = mixing.repetitions(odd).collect()
    assert len(rows) == 13
    size = collections.Counter()
    for r in odd.collect():
        size[r["source"]] += len(words(r["text"]))
    assert sum(size.values()) * 1.5 == pytest.approx(sum({r["row"]["source"]: r["target"] for r in rows}.values()))
    for r in rows:
        assert r["source_size"] == size[r["row"]["source"]] and r["target"] <= 2 * r["source_size"] and r["copies"] <= 2
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.repetitions(none).count() == 0


def test_mix_taken_is_near_target(spark):
    rows = queries.op1_mix(spark, "/root/testdata/sf0.1").collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r["source_size"], r["target"]] += r["taken"]
    total = sum(taken.values())
    assert total == pytest.approx(sum(t for _, t in taken), rel=0.02)


def test_exact_dedup(odd, none):
    rows = exact.mark_copies(odd, keep="largest").collect()
    groups = collections.defaultdict(list)
    lower = str.maketrans(exact.UPPER, exact.LOWER)
    for r in odd.collect():
        groups[(r["text"] or "").translate(lower)].append(r["doc_id"])
    assert len(rows) == 13
    for r in rows:
        norm = (r["row"]["text"] or "").translate(lower)
        ids = [i for i in groups[norm] if i is not None]
        assert r["keep_id"] == (max(ids) if ids else None) and r["group_size"] == len(groups[norm])
        assert r["kept"] == (r["doc_id"] == r["keep_id"]) and r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    once = exact.deduplicate(odd)
    assert once.columns == odd.columns and once.count() == len(groups)
    assert exact.deduplicate(none).count() == 0 and exact.mark_copies(none).count() == 0


def test_exact_dedup_tells_colliding_hashes_apart(odd, monkeypatch):
    real = exact.F.md5
    monkeypatch.setattr(exact.F, "md5", lambda c: real(F.lit("same")))
    rows = exact.mark_copies(odd).collect()
    sizes = {(r["row"]["text"] or "").lower(): r["group_size"] for r in rows}
    assert sizes["the cat  sat"] == 3 and sizes[""] == 3 and sizes["another text of one"] == 1


def test_html_text(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    model = html.fit(pages)
    for r in html.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect():
        want = "\n".join(b.text for b in html.labelled(r["html"]) if b.main)
        assert r["text"] == want and r["n_chars"] == len(want)
    edge = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p"), (3, "u", "&lt; &amp"), (4, "u", "<div" * 5000)], "page_id bigint, url string, html string")
    assert html.extract(edge, model).count() == 5
    assert html.extract(edge.limit(0), html.fit(edge.limit(0))).count() == 0
    other = model.extract(
        "<body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class='post'><h1>A title here</h1><p>One long  sentence&nbsp;of the"
        " text, which goes on for a while.<p>Another sentence of the text &amp; more of it.</div><div id=comments><p>I liked it very much, thanks.</p></div><footer>&copy; us</footer>"
    )
    assert other == "A title here\nOne long sentence of the text, which goes on for a while.\nAnother sentence of the text & more of it."


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>t</title><meta charset=x><body><p>One</p><p>Two</p></body></html>", ["One", "Two"]),
    ("<head><title>t</title><p>One<p>Two", ["One", "Two"]),
    ("<head><style>x</style></head><p>One", ["One"]),
    ('<p>One <svg class="i"/> more</p><p>Two</p>', ["One more", "Two"]),
    ("<p>One <svg><style/><path d=x /><text>no</text></svg> more</p><p>Two</p>", ["One more", "Two"]),
    ("<svg><svg><text>no</text></svg><text>no</text></svg><p>One</p>", ["One"]),
    ("<p>One</p><object data=x /><p>Two</p>", ["One", "Two"]),
    ("<div><button>Go</div><p>One</p><p>Two</p>", ["Go", "One", "Two"]),
    ("<body><button>Go<p>One</p><div><button>no</button></div><p>Two</p>", ["Go", "One", "Two"]),
    ("<p>One <button><b>no</b></button> more</p><select><option>no</select><iframe>no</iframe><noscript><p>no</p></noscript><p>Two", ["One more", "Two"]),
    ("<p>One</p><div><select><option>A</div><p>Two</p>", ["One", "A", "Two"]),
])
def test_html_keeps_what_follows_unclosed_and_self_closed_elements(page, want):
    assert [b.text for b in html.blocks(page)] == want


def test_viterbi_is_the_best_sequence():
    rng = random.Random(4)
    for _ in range(30):
        found = [html.Block("p", (f"f{rng.randint(0, 3)}",), "x y z") for _ in range(6)]
        model = html.Field({f"f{i}": rng.uniform(-2, 2) for i in range(4)}, ((rng.random(), rng.random()), (rng.random(), rng.random())))
        e = [sum(model.weights.get(f, 0) for f in html.features(b, i, 6)) for i, b in enumerate(found)]

        def value(s):
            return sum(x for x, on in zip(e, s) if on) + sum(model.change[a][b] for a, b in zip(s, s[1:]))

        best = max(value([bool(k >> i & 1) for i in range(6)]) for k in range(64))
        assert value(model.decode(found)) == pytest.approx(best)


def test_quality_on_held_out_rows(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op4_quality(spark, sf).filter("held_out").join(labels, "doc_id").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert len(rows) > 300 and sum(good) / len(good) > 0.97 and 1 - sum(bad) / len(bad) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    model = quality.fit(documents(spark), spark.read.parquet(f"{SMALL}/labels.parquet"))
    scored = quality.score(odd, model).collect()
    assert len(scored) == 13 and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.accepted(odd, model).columns == odd.columns
    assert quality.score(none, quality.fit(none, labels.limit(0))).count() == 0


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\/INST]", "<s>[INST] user [/INST]", "", "</s", "a<", "\\", "[/INST", " [/INST]x", "é\n</s>"]
    rng = random.Random(1)
    data = [(c, t, rng.choice(["user", "assistant", "sys [/INST] </s>", ""]), "".join(rng.choice(hard) for _ in range(rng.randint(0, 3)))) for c in range(80) for t in range(rng.randint(1, 6))]
    data += [(None, None, None, None), (900, 1, "assistant", None), (900, 1, "assistant", None), (901, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in data], "conv_id bigint, turn bigint, role string, text string, nr int, out string")
    out = chat.format_conversations(df).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    want = collections.defaultdict(list)
    for c, t, r, x in data:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    assert len(out) == len(want)
    for r in out:
        turns = sorted(want[r["conv_id"]])
        assert [tuple(x) for x in r["turns"]] == [(a, b) for _, a, b in turns]
        assert r["loss"] == "".join(b for _, a, b in turns if a == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_bpe_equals_the_library(spark, odd, none):
    library = Tokenizer.from_file(PATH)
    code = bpe.Encoder(PATH, cached=50)
    parts = ["a", "B", "é", "É", "Σ", "ς", "İ", "ß", "é", "\xa0", " ", "\x1c", "\x85", " ", "\n", "'s", "'ll", "'", "1", "²", "漢", "字", "😀", "<|endoftext|>", "<|", "!", "***", "th", "ing", "_", "\x00", "qxzj", "ıÿ"]
    rng = random.Random(3)
    for text in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]:
        want = library.encode(text, add_special_tokens=False).ids
        got = code.encode([text.encode()])[0]
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text)
        assert code.decode(got).decode() == library.decode(want, skip_special_tokens=False)
    for r in queries.op6_bpe(spark, SMALL).join(documents(spark).select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    rows = bpe.encode_texts(odd, PATH).collect()
    assert all(r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids for r in rows)
    assert bpe.encode_texts(none, PATH).count() == 0


def test_fragments_are_cut_where_nothing_can_merge():
    code = bpe.Encoder(PATH)
    parts, word_of, last = code.fragments(["qxqzj", "the"])
    assert "".join(parts) == "qxqzjthe" and len(parts) > 2 and parts[-1] == "the"
    assert word_of[-1] == 1 and last[-1] and sum(last) == 2


def test_section_counts(spark, odd):
    library = Tokenizer.from_file(PATH)

    def sections(text):  # overlapping, with gaps, and cutting tokens
        return [(i, i + 9) for i in range(2, len(text) + 1, 7)]

    rows = token_counts.section_counts(odd.filter("length(text) < 1000 or text is null"), PATH, sections).collect()
    got = collections.Counter((r["doc_id"], r["start"], r["n_tokens"]) for r in rows)
    want = collections.Counter()
    for r in odd.collect():
        text = r["text"] or ""
        if len(text) < 1000:
            at = [s for s, _ in library.encode(text, add_special_tokens=False).offsets]
            want.update((r["doc_id"], s, sum(s <= a < e for a in at)) for s, e in sections(text))
    assert got == want
    total = {r["doc_id"]: r["n"] for r in queries.op7_token_counts(spark, SMALL).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert all(total[r["doc_id"]] == len(library.encode(r["text"], add_special_tokens=False).ids) for r in documents(spark).collect())


def test_token_files_look_words_of_longer_stretches_up_at_once(monkeypatch):
    """Before, 1.5 MB at a time: a word in every stretch was looked up, and its fragments cut, more often."""
    code, calls, known = bpe.encoder(PATH), [], bpe.Encoder.known
    monkeypatch.setattr(bpe.Encoder, "known", lambda self, wanted: calls.append(len(wanted)) or known(self, wanted))
    texts = [(f"word{i % 9} and more é" * 2000).encode() for i in range(90)]
    assert code.encode(texts, simple8b.BYTES_AT_ONCE) == code.encode(texts) and sum(map(len, texts)) > bpe.BYTES_AT_ONCE
    assert calls[0] == max(calls) and len(calls) > 2


def test_simple8b_selectors_are_the_narrowest():
    rng = np.random.default_rng(3)
    for t in range(120):
        widths = rng.integers(0, [4, 17, 34, 60][t % 4] + 1, int(rng.integers(0, 150)))
        ids = np.array([int(rng.integers(0, 1 << 60)) & ((1 << int(b)) - 1) for b in widths], np.uint64)
        want = [next(k for k, (n, bits) in enumerate(simple8b.SELECTORS) if all(int(x) >> bits == 0 for x in ids[i : i + n])) for i in range(len(ids))]
        assert simple8b.selectors_of(ids).tolist() == want


def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    for bits in (0, 1, 3, 7, 16, 31, 59, 60, 63):
        for n in (0, 1, 59, 61, 1000):
            ids = rng.integers(0, 2**bits, n, dtype=np.uint64) >> rng.integers(0, bits + 1, n).astype(np.uint64)
            words, at, values = simple8b.pack(ids)
            assert (simple8b.unpack(words, n, at, values) == ids).all()
    assert len(simple8b.pack(np.zeros(600, np.uint64))[0]) == 10


def test_token_files(spark, odd, none, tmp_path):
    library = Tokenizer.from_file(PATH)
    for name, df in (("a", documents(spark)), ("b", odd), ("c", none)):
        simple8b.write_tokens(df, PATH, f"{tmp_path}/{name}", 2)
        rows = simple8b.read_tokens(spark, f"{tmp_path}/{name}").collect()
        want, start = [], 0
        for r in sorted(df.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]):
            ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == collections.Counter(want)
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == start
            start += r["n_tokens"]
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
        assert ids == sorted(ids)


def near_brute(rows, width, percent):
    lower = str.maketrans(exact.UPPER, exact.LOWER)
    sets = []
    for _, text in rows:
        w = words((text or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = collections.defaultdict(set)
    for k, s in enumerate(sets):
        for x in s:
            at[x].add(k)
    for k, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in at[x] if j > k)
        for j, both in shared.items():
            a, b = rows[k][0], rows[j][0]
            if a is not None and b is not None and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(a), root(b)))
                parent[b] = a
    return collections.Counter((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets))


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, odd, none, width, percent):
    for df in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd):
        got = setsketch.near_duplicates(df, width, percent).collect()
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_brute(rows, width, percent)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert setsketch.near_duplicates(none).count() == 0 and setsketch.deduplicate(none).count() == 0
    assert setsketch.deduplicate(odd).columns == odd.columns


def test_near_duplicates_of_a_hot_group(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for i in range(700):  # copies with few to many edits: some are linked, some are not
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 99999)}"
        rows.append((i, " ".join(w)))
    got = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == near_brute(rows, 3, 85)


def test_near_duplicates_of_a_repeated_id(spark):
    """Each text of an id finds its own neighbours, in whatever order the rows come."""
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    near_b = b.replace("b59", "other")
    near_a = a.replace("a59", "other")
    for rows in ([(1, a), (1, b), (2, near_b)], [(1, b), (1, a), (2, near_b)], [(1, a), (1, b), (2, near_b), (3, near_a), (5, "z y x w v")]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
        got = {r["doc_id"]: r["component_id"] for r in setsketch.near_duplicates(df, 5, 80).collect()}
        assert got == {i: 5 if i == 5 else 1 for i, _ in rows}


def test_joint_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.85, 1.0):
        n = 2000
        both = int(2 * n * j / (1 + j))
        x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        r = setsketch.registers([x[:n], x[n - both :]], 1024)
        assert abs(float(setsketch.joint_jaccard(r[0], r[1], np.float64(n), np.float64(n))) - j) < 0.06
    merged = setsketch.registers([np.concatenate((x[:50], x[50:90]))], 64)
    parts = setsketch.registers([x[:50], x[50:90]], 64)
    assert (merged[0] == parts.max(0)).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 3000 + i) for i in range(200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}


def test_nearest(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    hits = total = 0
    got = collections.defaultdict(list)
    for r in queries.op10_nearest(spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = sorted((a, b) for a, b in zip(d.tolist(), ids.tolist()) if b != q)[:10]
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 11)) and [s for *_, s in found] == sorted(s for *_, s in found)
        for _, v, s in found:
            assert s == pytest.approx(d[ids == v][0], rel=1e-12)
        hits += len({b for _, b in best} & {v for _, v, _ in found})
        total += 10
    assert hits / total >= 0.9


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [(100 * i, [1.0, 2.0]) for i in range(1, 30)]
    rows = [(0, [1.0, 0.0]), (None, [1.0, 1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), *same]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, node int")
    use = nndescent.usable(df)
    index = nndescent.build(use)
    got = collections.defaultdict(list)
    for r in nndescent.search(index, index.queries("vec_id % 100 = 0")).orderBy("rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == [7] + [100 * i for i in range(1, 10)]
    assert got[500] == [i * 100 for i in range(1, 12) if i != 5]
    empty = nndescent.build(use.limit(0))
    assert nndescent.search(empty, empty.queries("vec_id % 100 = 0")).count() == 0


def test_nearest_of_repeated_ids(spark):
    """Rows are queries and candidates of their own, also where an id has two vectors or a row repeats."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 8))
    ids = [i // 2 * 50 for i in range(40)] + [10_007 + 100 * i for i in range(360)]
    x[39] = x[38]  # a repeated row
    x[60] = x[61]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id bigint, embedding array<double>").repartition(3)
    index = nndescent.build(nndescent.usable(df))
    got = collections.defaultdict(list)
    for r in nndescent.search(index, index.queries("vec_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = collections.defaultdict(list)
    for q in range(40):
        if ids[q] % 100 == 0:
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            best = sorted((d[i], ids[i]) for i in range(400) if i != q)[:10]
            want[ids[q]] += [(k + 1, v, s) for k, (s, v) in enumerate(best)]
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    for q in want:
        assert sorted((r, v) for r, v, _ in got[q]) == sorted((r, v) for r, v, _ in want[q])
        assert sorted(s for *_, s in got[q]) == pytest.approx(sorted(s for *_, s in want[q]))


def nearest_recall(spark, x, step):
    """Share of the true ten nearest that the index finds for every ``step``-th vector."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>").repartition(8)
    use = nndescent.usable(df)
    index = nndescent.build(use)
    got = collections.defaultdict(set)
    for r in nndescent.search(index, index.queries(f"vec_id % {step} = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for i in range(0, len(x), step):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & got[i])
        total += 10
    return hits / total


@pytest.mark.parametrize("spread, outlier", [(1e-6, None), (None, 1e8)])
def test_nearest_of_near_copies_and_beside_an_outlier(spark, spread, outlier):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5000, 16))
    if spread:
        x = x[0] + spread * x
    if outlier:
        x[77] *= outlier
    assert nearest_recall(spark, x, 100) >= 0.9


def test_nearest_widens_beams_until_the_recall_is_reached(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BEAM", 11)
    assert nearest_recall(spark, np.random.default_rng(4).standard_normal((3000, 48)), 60) >= 0.9


def test_nearest_scans_where_the_graph_does_not_lead(spark):
    rows = [(i, [float(i), 1.0]) for i in range(300)]
    use = nndescent.usable(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    index = nndescent.build(use)
    index.graph = index.graph.limit(0)
    q = index.queries("vec_id % 50 = 0")
    got = collections.defaultdict(list)
    for r in nndescent.search(index, q, 2).orderBy("rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [1, 2], **{i: [i - 1, i + 1] for i in range(50, 300, 50)}}


def test_nearest_takes_few_jobs_however_many_shards(spark, monkeypatch):
    """Rounds and steps run inside a shard's task, not as jobs of their own; the shards' answers are merged,
    also where groups of vectors lie far apart."""
    monkeypatch.setattr(nndescent, "SIZE", 200)
    rng = np.random.default_rng(6)
    x = 100 * rng.standard_normal((60, 1, 24)) + rng.standard_normal((60, 50, 24))
    spark.sparkContext.setJobGroup("few", "")
    try:
        assert nearest_recall(spark, x.reshape(-1, 24), 30) >= 0.9
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_nearest_sizes_follow_the_table():
    for size_of in (nndescent.degree_for, nndescent.beam_for, nndescent.rounds_for):
        assert size_of(100) == size_of(50_000) < size_of(200_000) < size_of(10_000_000)


def test_pipeline(spark):
    docs = corpus_pipeline.table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "test")
        if name != "encode":
            assert docs.columns == before.columns
        if name == "exact_dedup":
            assert docs.count() == len({(r["text"] or "").lower() for r in before.collect()})
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert docs.count() == sum(i == c for i, _, c in near_brute(rows, 5, 80))
    assert docs.columns == [*before.columns, "ids", "decoded"] and docs.count() == before.count()
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
