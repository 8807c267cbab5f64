"""Suffix arrays, spelling variants and tokenizer alignment against brute force; samples, caches and depths of the others."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from waygrid.llm import alignment, ann, common, html, queries, spelling, suffixes, tokens, toxicity


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda x: tuple(map(str, x)))


def in_order(rows):
    return sorted(rows, key=lambda x: tuple(map(str, x)))


# Suffix arrays ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "\x00\xfe"])
def test_two_stage_order_is_the_order_of_suffixes(letters):
    r = random.Random(letters)
    for _ in range(120):
        data = np.array([ord(r.choice(letters)) for _ in range(r.randint(1, 250))], np.uint8)
        wanted = np.array([r.random() < r.choice([0.1, 0.5, 1.0]) for _ in data])
        raw = data.tobytes()
        order = suffixes.two_stage_order(data, wanted, 300).tolist()
        want = sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:] + b"\0" * i)
        assert [raw[i:].rstrip(b"\0") for i in order] == [raw[i:].rstrip(b"\0") for i in want] if "\0" in letters else order == sorted(want, key=lambda i: raw[i:])


def test_common_prefixes():
    raw = b"banana"
    data = np.frombuffer(raw, np.uint8)
    order = suffixes.two_stage_order(data, np.ones(6, bool), 6)
    assert order.tolist() == [5, 3, 1, 0, 4, 2]
    assert suffixes.common_prefixes(data, order, 6).tolist() == [1, 3, 0, 0, 2]


def cut(rows, length):
    seen = collections.Counter()
    texts = [(k, (t or "").encode()) for k, t in rows]
    for _, b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for k, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return in_order(out)


@pytest.mark.parametrize("whole, block, look", [(3000, 1500, 1 << 18), (20, 10, 1 << 18), (3000, 1500, 700)])
def test_repeats_go_wherever_they_stand(spark, monkeypatch, whole, block, look):
    """Also where one passage fills most of the rows with different surroundings, so that its anchors are split into blocks."""
    for name, value in (("WHOLE", whole), ("BLOCK", block), ("LOOK", look)):
        monkeypatch.setattr(suffixes, name, value)
    r = random.Random(3)
    said = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passage = said(320)
    rows = [(i, said(r.randint(0, 260)) + passage[r.choice([0, 0, 0, 50]) :] + said(r.randint(0, 260))) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "x" * 199), (None, "y" * 200), (102, "y" * 200), (103, "z" * 900), (104, "ab" * 300), (105, said(3000)), (105, said(500))]
    rows += [(106, rows[-1][1]), (106, rows[-1][1]), (107, rows[-2][1][700:1300] + "tail"), (108, "z" * 150 + passage[:199])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash")).withColumn("id", F.lit(1)).repartition(5)
    out = suffixes.without_repeats(df)
    assert as_rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut(rows, 200)


def test_many_anchors_and_copies_meet_in_shuffles(spark, monkeypatch):
    """Beyond the bound of a broadcast the same rows come out."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", 1)
    r = random.Random(11)
    base = ["".join(r.choice("abcdef") for _ in range(700)) for _ in range(4)]
    rows = [(i, base[i % 4][r.randrange(200) :] + str(i) * 5 + base[(i + 1) % 4][: r.randrange(100, 500)]) for i in range(24)] + [(50 + i, base[0]) for i in range(3)]
    assert as_rows(suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut(rows, 200)


def test_spans_and_kept_bytes(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(250))
    df = spark.createDataFrame([(1, "start é " + text + " end"), (2, text), (3, "alone"), (4, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffixes.without_repeats(df, with_text=True).collect()}
    assert [tuple(x) for x in got[1]["spans"]] == [(9, 259)] and bytes(got[1]["kept"]).decode() == "start é  end"
    assert [tuple(x) for x in got[2]["spans"]] == [(0, 250)] and bytes(got[4]["kept"]) == b""
    assert got[3]["spans"] == [] and got[3]["n_removed"] == 0


# Spelling variants --------------------------------------------------------------------------------------------------------


def variants(rows, slip, shortest, least, times):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if slip and h % slip == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    letters = {x for w in n for x in w}
    near, form = {}, {}
    for w in n:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in letters} | {w[:i] + x + w[i:] for i in range(len(w) + 1) for x in letters}
        near[w] = {x for x in made - {w} if x in n}
        best = min(near[w], key=lambda x: (-n[x], x)) if near[w] else None
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return in_order(out)


@pytest.mark.parametrize("slip, shortest, least", [(199, 6, 5), (3, 2, 1), (None, 1, 1)])
def test_variants_are_those_of_all_pairs(spark, sf, slip, shortest, least):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(None, "hello hallo"), (None, None), (7, ""), (7, ""), (8, "aaaaaa aaaaaaa " * 30 + "aaaaab " * 5 + "ÀÀÀàéé " * 6 + "×÷×÷×÷ " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(9)).repartition(4)
    got = spelling.spelling_variants(spelling.vocabulary(df, slip=slip, shortest=shortest, least=least))
    assert as_rows(got, "word", "n", "n_near", "form", "form_n", "root") == variants(rows, slip, shortest, least, 5)


def test_roots_of_a_long_chain(spark):
    words = spark.createDataFrame([("a" * (6 + i), 6**i) for i in range(12)], "word string, n long")
    got = {r["word"]: r for r in spelling.spelling_variants(words).collect()}
    assert {r["root"] for r in got.values()} == {"a" * 17}
    assert got["a" * 7]["form"] == "a" * 8 and got["a" * 7]["n_near"] == 2 and got["a" * 17]["form"] is None


# Alignment ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)


def aligned_by_loops(pair, rows):
    """Documents with their links, and how many documents link each pair; by the libraries and plain loops."""
    found, linked = [], collections.Counter()
    for key, text in rows:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            found.append((key, [], [], [], ""))
            continue
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (x, y)]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        groups, at = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            own = [",".join(str(t) for t, e in zip(ids, end) if at < e <= cut) for ids, end in ((a, ends[0]), (b, ends[1]))]
            groups.append("|".join(own))
            at = cut
        found.append((key, a, b, links, ";".join(groups)))
        linked.update(set(links))
    best = collections.Counter()
    for (a, _), n in linked.items():
        best[a] = max(best[a], n)
    rows = [
        (k, len(a), len(b), g.count("|"), len(ls), sum(linked[x] == best[x[0]] for x in ls), sum(linked[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for k, a, b, ls, g in found
    ]
    return in_order(rows), {k: (n, n == best[k[0]]) for k, n in linked.items()}


@pytest.mark.parametrize("chunk", [4_000_000, 300])
def test_alignment_equals_loops(spark, pair, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", chunk)
    monkeypatch.setattr(alignment, "SLICE", 100 if chunk == 300 else 65_536)
    rows = [(1, "The quick brown fox jumped over the lazy dogs."), (1, "The quick brown fox jumped over the lazy dogs."), (2, None), (3, ""), (None, "hello world"), (4, " two  blanks \n and\ta tab "), (5, "a▁b"), (6, "日本語 <|endoftext|> <s> </s> <unk>")]
    rows += [(7, "Überraschung\nnaïve café – “quoted” … €5"), (8, "x" * 3000), (9, "\x00 nul"), (10, " "), (11, "\n"), (12, "é ﬁ Ⅷ")]
    rows += [(20 + i, " ".join(random.Random(i).choice(["alpha", "beta", "gamma's", "delta,", "12345", "über"]) for _ in range(60))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n_a", F.lit(1)).repartition(3)
    out, pairs = alignment.align_tokenizers(spark, df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN, with_groups=True)
    want, linked = aligned_by_loops(pair, rows)
    assert as_rows(out, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups") == want
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == linked


def test_plain_texts_are_encoded_as_by_the_library(pair):
    hypothesis = pytest.importorskip("hypothesis")
    from hypothesis import strategies as st

    @hypothesis.settings(max_examples=300, deadline=None)
    @hypothesis.given(st.text(st.sampled_from("ab'sZ09 .,-\t\n\r é\xad\xaaßĀɏ–€‐‰")))
    def same(text):
        units = pair.units(text)
        a, b = pair.encode(units)
        assert sum(a, []) == pair.a.encode(" " + text, add_special_tokens=False).ids
        assert not text or sum(b, []) == pair.b.encode(text)

    same()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.without_repeats(docs).count() == 0
    assert spelling.spelling_variants(spelling.vocabulary(docs)).count() == 0
    out, pairs = alignment.align_tokenizers(spark, docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
    assert out.count() == 0 and pairs.count() == 0


# The others ---------------------------------------------------------------------------------------------------------------


def test_a_full_cache_shuffles_no_texts(spark, tmp_path, monkeypatch):
    path, cache = P.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(i, f"some words of text {i % 7}") for i in range(60)], "doc_id long, text string")
    first = as_rows(tokens.count_tokens(spark, docs, path, cache), "doc_id", "n_tokens")
    encoded = []
    kept = tokens._encoded
    monkeypatch.setattr(tokens, "_encoded", lambda spark, texts, path: encoded.append(texts) or kept(spark, texts, path))
    assert as_rows(tokens.count_tokens(spark, docs, path, cache), "doc_id", "n_tokens") == first
    assert encoded[0].count() == 0
    plan = encoded[0]._jdf.queryExecution().executedPlan().toString()
    before = plan.split("Scan ExistingRDD")[0] if "Scan ExistingRDD" in plan else plan
    assert "BroadcastHashJoin" in before  # missing digests go to the texts; what is grouped afterwards are misses


def test_the_sample_of_the_toxicity_fit_counts_documents(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda slots, labels, pairs, *more: fitted.append(len(slots)) or (np.zeros(0, int), np.zeros(0), 0.0))
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(300)] + [(i, f"text number {i} of them") for i in range(2, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 200)], "doc_id long, toxic int")
    toxicity.learn(docs, labels)
    assert fitted == [40]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_any_depth_reaches_the_recall(spark, depth):
    """Vectors without clusters, where deep probes can't reach enough: the depth gives way, not the recall."""
    x = np.random.default_rng(5).normal(size=(1500, 32))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.filter("vec_id % 25 = 0"), k=10, depth=depth).toPandas()
    hits = 0
    for q, mine in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        hits += len({i for i in np.lexsort((np.arange(len(x)), d)) if i != q} and set([i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]) & set(mine["vec_id"]))
    assert hits / 600 >= 0.9


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = ann.nearest(df, df.filter("vec_id = 0"), k=10).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 3)]


SENTENCE = "We talk about what this means for all of the people who have been there, and how it was when they came to the city with us. "


@pytest.mark.parametrize(
    "inside, text",
    [
        (f"<p>{SENTENCE}</p><section id='discussion'><h2>Discussion</h2><p>{SENTENCE}</p></section>", f"{SENTENCE}Discussion {SENTENCE}"),
        (f"<p>{SENTENCE}</p><h2 id='related-work'>Related work</h2><p>{SENTENCE}</p>", f"{SENTENCE}Related work {SENTENCE}"),
        (f"<p>{SENTENCE}</p><h2 id='search-algorithms'>Search</h2><p>{SENTENCE}</p>", f"{SENTENCE}Search {SENTENCE}"),
        (f"<section id='social-impact'><p>{SENTENCE}</p></section><p>{SENTENCE}</p>", f"{SENTENCE}{SENTENCE}"),
        (f"<p>{SENTENCE}</p><div class='ad-hoc-analysis'><p>{SENTENCE}</p></div>", f"{SENTENCE}{SENTENCE}"),
        (f"<p>{SENTENCE}</p><div class='comments'><p>{SENTENCE}</p></div><div id='comment-list'><p>{SENTENCE}</p></div><div class='ad'>{SENTENCE}</div>", SENTENCE),
        (f"<p>{SENTENCE}</p><div id='share'><p>Share this</p></div><div id='related'><a>One</a></div><p>{SENTENCE}</p>", f"{SENTENCE}{SENTENCE}"),
    ],
)
def test_names_of_subjects_keep_their_text(inside, text):
    assert html.main_text(f"<nav><a>Home</a></nav><article>{inside}</article>")[0] == " ".join(text.split())


@pytest.mark.parametrize("name", ["op11_suffixes", "op12_spelling"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    found = con.execute(queries.ORACLE[name])
    at = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert as_rows(df, *df.columns) == in_order([tuple(r[i] for i in at) for r in found.fetchall()])
