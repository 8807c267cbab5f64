import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from waygrid.llm import minhash
from waygrid.llm.minhash import near_duplicates, prefix_lengths


def brute(rows, size, percent):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets[key] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 40, 120]))] for _ in range(60)]
    rows = []
    for base in bases:
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(copy)
    hub = [rng.choice(words) for _ in range(150)]  # many copies near the hub, not all near each other
    for _ in range(300):
        copy = list(hub)
        for _ in range(rng.randint(0, 10)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(x)) for i, x in enumerate(rows)] + [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "one"), (9004, "ONE"), (9005, "É a"), (9006, "é a")]


@pytest.mark.parametrize("size", [2, 5])
def test_matches_brute_force(spark, size):
    rows = corpus(size)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 as key", "2 as band", "'x' as component")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df.repartition(5), size=size).collect()}
    assert got == brute(rows, size, 80)


@pytest.mark.parametrize("size", [2, 5])
def test_hot_buckets_meet_by_rare_shingles(spark, size, monkeypatch):
    monkeypatch.setattr(minhash, "DEALT", 0)  # every bucket with strays is hot
    rows = corpus(size + 10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df.repartition(5), size=size).collect()}
    assert got == brute(rows, size, 80)


@pytest.mark.parametrize("share", [0.7, 0.86])
def test_a_bucket_of_strays_is_not_dealt_as_its_square(spark, share, monkeypatch):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(int(100 * share))]
    texts = [" ".join(passage + [f"u{n}_{i}" for i in range(100 - len(passage))]) for n in range(20_000)]
    for n in range(0, 200, 2):  # copies among them
        words = texts[n].split()
        words[rng.randrange(90, 99)] = "changed"
        texts[n + 1] = " ".join(words)
    dealt = []
    whole = minhash._leftover_blocks

    def counted(*given):
        blocks = minhash.written(whole(*given), "blocks")
        dealt.append(blocks.count())
        return blocks

    monkeypatch.setattr(minhash, "_leftover_blocks", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_duplicates(df.repartition(4), size=1).collect()}
    assert found == {n: n - 1 if n < 200 and n % 2 else n for n in range(20_000)}
    assert dealt[0] < 2_000_000


@given(st.sets(st.integers(0, 30), min_size=1), st.sets(st.integers(0, 30), min_size=1), st.integers(50, 100))
def test_prefixes_of_linked_sets_meet(x, y, percent):
    small, large = sorted((x, y), key=len)
    if 100 * len(x & y) >= percent * len(x | y):
        assert set(sorted(large)[: prefix_lengths(len(large), percent)[0]]) & set(sorted(small)[: prefix_lengths(len(small), percent)[1]])


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "word " * 30000)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(df, size=2).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("2", 2, "1", False), ("3", 1, "3", True), ("None", 2, "None", True)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []
