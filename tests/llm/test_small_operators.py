"""Encoders, extraction, matching and licences against brute force and planted cases."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from waygrid.llm import bpe, decontaminate, html, licenses, tokens

RANKS = bpe.load_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines())
OURS = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
COUNTER = tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_bpe_equals_library_and_round_trips(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text) and OURS.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab eé\n \t'’<|startoftext|>ABḈ 日1")))
def test_bpe_and_counts_on_awkward_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert COUNTER.count(text) == COUNTER.counts([text])[0]


def test_bpe_query_columns(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = bpe.encode_documents(spark, df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and {r["ids_sha256"] for r in got if r["doc_id"] in (2, 3)} == {empty}
    for r in got:
        text = dict((str(k), v) for k, v in rows)[str(r["doc_id"])] or ""
        assert list(r["ids"]) == THEIRS.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    none = bpe.encode_documents(spark, df.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert none.collect() == []


def test_token_cache_encodes_only_what_is_missing(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    first = spark.createDataFrame([(1, "Hello there, world"), (2, " Hello  there, world\n"), (3, None), (4, "Hello there, world")], "doc_id long, text string")
    more = first.union(spark.createDataFrame([(5, "something else"), (6, "")], "doc_id long, text string"))
    a = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(spark, first, path, cache).collect()}
    stored = spark.read.parquet(cache).count()
    b = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(spark, more, path, cache, limit=2).collect()}
    assert stored == 2 and spark.read.parquet(cache).count() == 3  # two texts, then one more
    assert a == {1: 4, 2: 4, 3: 0, 4: 4} and b[5] == (14, 2, False) and b[6] == (0, 0, False) and b[1] == (18, 4, True)


def test_token_counts_of_null_and_repeated_keys(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "only here"), (None, "one two three four five"), (7, "short"), (7, "a much longer text of the same key"), (8, None), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = tokens.count_tokens(spark, docs, path, f"file://{tmp_path}/cache").collect()
    want = [(key, len((text or "").encode()), COUNTER.count(text or "")) for key, text in rows]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in got)
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 5  # each text once, the empty one too


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<script>x</script><!-- c -->", ""),
        ("<p>a<b>b</b>c &amp; d</p><div>e</div>", "abc & d e"),
        ("<nav><a href=x>Home</a></nav><article><header><h1>T</h1></header><p>One\n two<br>three<p>Four</article><footer>f</footer>", "T One two three Four"),
        ("<main><p>Kept.</p><div class='comments'><p>A reader says something</p></div><aside>x</aside></main><div id=cookie-notice>y</div>", "Kept."),
        ("<article><p>Text</p><form><input>Subscribe</form><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul></article>", "Text"),
        ("<p>unclosed <b>bold", "unclosed bold"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page)[0] == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article style='overflow:hidden'>Kept</article>", "Kept"),
        ("<article><div aria-hidden=false>One</div><p title='The hidden valley'>Two</p><p data-x='display:none'>Three</p></article>", "One Two Three"),
        ("<article>A<div hidden>x</div><div aria-hidden='true'>y</div><div style='color:red; DISPLAY : none'>z</div><p>B</article>", "A B"),
        ("<article class='post tag-social'>Kept</article>", "Kept"),
        ("<div class='content has-sidebar'><article>Kept</article></div>", "Kept"),
        ("<div class='row related-search-off'><main>Kept</main></div>", "Kept"),
        ("<div class='modal social'><article class='widget'>Kept<div class=comments>x</div></article></div>", "Kept"),
        ("<article>Kept</article><div class=comments><article class=comment>A reader</article></div>", "Kept"),
        ("<article>Kept<div class='site-footer'>x</div><div id=adBanner>y</div></article>", "Kept"),
        ("<div hidden><article>x</article></div>", ""),
    ],
)
def test_furniture_is_told_by_whole_names(page, text):
    assert html.main_text(page)[0] == text


def test_short_blocks_follow_their_neighbours():
    prose = "the cat and the dog are in the house and they have been there for a long time with all of their friends and it was good for them to be there " * 2
    links = "<ul>" + "".join(f"<li><a href=x>Section {i} of the list of links</a></li>" for i in range(4)) + "</ul>"
    text, _, _ = html.main_text(f"{links}<p>Short start</p><p>{prose}</p><p>Short end</p><p>{prose}</p>{links}<p>Last words</p>")
    assert "Short end" in text and "Section" not in text and "Last words" not in text


def naive_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=70), st.text(alphabet="abc ", max_size=90))
def test_bit_parallel_distance(a, b):
    assert decontaminate.best_distance(a, b)[0] == naive_distance(a, b)


def test_planted_items_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(12)] + [(90, None), (91, " ")]
    docs, want = [(500, None), (501, ""), (502, " ".join(word() for _ in range(400)))], set()
    for i, item in items[:12]:
        chars = list(item.upper())
        for _ in range(i):  # ever more edits; the budget is 8 % of some 220 characters
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        docs.append((i, " ".join(word() for _ in range(30)) + ", " + "".join(chars) + "! " + word()))
        want.add((i, i))
    got = decontaminate.find_items(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), scan=1500)
    assert {(r["doc_id"], i) for r in got.collect() for i in r["item_ids"]} == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(spark, spark.createDataFrame(docs, "doc_id long, text string"), none).collect() == []


@pytest.mark.parametrize("item, text, found", [("cat", "concatenate", False), ("cat", "a Cat!", True), ("ai", "training", False), ("art", "party art", True), ("art", "", False)])
def test_items_stand_between_words(item, text, found):
    matcher = decontaminate.Matcher([(1, decontaminate.normalised(item))], decontaminate.RATE)
    assert bool(matcher.matches(text)) == found


def test_items_equal_brute_force(spark):
    """Every item against every stretch of every text, by the plain edit distance."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    items = [(i if i % 5 else None, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    docs = []
    for i in range(60):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        if i % 2:
            near = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 5)):
                near[rng.randrange(len(near))] = rng.choice("abcd ")
            parts.insert(rng.randrange(len(parts) + 1), "".join(near))
        docs.append((i, rng.choice([" ", "  ", ", "]).join(parts)))
    want = set()
    for d, text in docs:
        for _, item in items:
            a, b = decontaminate.normalised(item), decontaminate.normalised(text)
            distance = naive_distance(a, b) if b else 99
            if distance <= int(decontaminate.RATE * (len(a) - 2)):
                want.add((d, item, distance))
    by_key = {}
    for k, item in items:
        by_key.setdefault(k, set()).add(item)
    got = decontaminate.find_items(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), scan=300)
    pairs = sorted((r["doc_id"], str(k), n) for r in got.collect() for k, n in zip(r["item_ids"], r["distances"]))
    assert pairs == sorted((d, str(k), n) for d, item, n in want for k, other in items if other == item) and pairs


def test_long_runs_are_linear_and_bounded():
    coder = bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", "\u7684\u4e00\u662f\u4e0d\u4e86", "ab"):
        text = "".join(rng.choice(alphabet) for _ in range(200_000))
        began = time.time()
        ids = coder.encode(text)
        assert time.time() - began < 5 and coder.decode(ids) == text.encode()
        assert coder.encode(text[:3000]) == THEIRS.encode_ordinary(text[:3000])
    assert max(map(len, [*coder.runs, *coder.pieces]), default=0) <= bpe.KEPT


@pytest.mark.parametrize("page", ["<b>" * 8000 + "</i>" * 8000, "<a " * 8000, "<a " * 8000 + "'>", '<a "' * 8000, "<script " * 8000, "<div>" + "<b>" * 8000 + "<hr>" * 8000, "<i><div>" + "<b>" * 8000 + "</i>" * 8000, "<article>" + "<p><a>x</a></p>" * 8000])
def test_broken_pages_take_no_longer(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 1


PROSE = "the cat and the dog are in the house and they have been there for a long time with all of their friends and it was good for them to be there "


@pytest.mark.parametrize(
    "inside, text",
    [
        # A teaser of links and the short line between two of them go; a lone link line and low-density text between prose stay.
        (f"<p>{PROSE}</p><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><p>See also</p><ul><li><a>four</a><li><a>five</a><li><a>six</a></ul><p>{PROSE}</p>", f"{PROSE}{PROSE}"),
        (f"<p>{PROSE}</p><p><a>Source</a></p><p>{PROSE}</p>", f"{PROSE}Source {PROSE}"),
        (f"<p>{PROSE}</p><pre>x = 1; y = 2; zz = foo(bar, 3); qq = foo(bar, 4); rr = foo(bar, 5); ss = x</pre>", f"{PROSE}x = 1; y = 2; zz = foo(bar, 3); qq = foo(bar, 4); rr = foo(bar, 5); ss = x"),
        (f"<p>{PROSE}</p><p><a>Harbour tickets today</a> <a>Bridge opening soon</a> <a>Market prices rising</a> <a>Weather outlook</a></p>", PROSE),
        ("<p>Short</p><form>Subscribe</form><p>End</p>", "Short End"),
    ],
)
def test_densities_decide_inside_articles(inside, text):
    assert html.main_text(f"<nav><a>Home</a></nav><article>{inside}</article>")[0] == " ".join(text.split())


def test_both_passes_decide_blocks_of_pages(spark):
    """How many blocks of the driver's pages each pass decides, and both against a plain restatement of the rules."""
    decided = {"density": 0, "neighbours": 0}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        found = html.blocks(r["html"] or "")
        html.first_pass(found)
        own = [b for b in found if b.article and not b.furniture]
        for b in own:
            words = html.WORD.findall(b.text.lower())
            dense = sum(w in html.STOP_WORDS for w in words) >= html.SOME_STOPS * max(1, len(words))
            assert b.label == ("good" if len(b.text) >= html.SHORT and dense and b.links <= html.MANY_LINKS * len(b.text) else "")
        first = [b.label for b in own]
        html.second_pass(found)
        for i, b in enumerate(own):
            near = sorted((abs(i - j), x != "good") for j, x in [(-1, "good"), *((j, x) for j, x in enumerate(first) if x), (len(own), "good")])
            assert b.label == ("bad" if near[0][1] else "good")
        decided["density"] += sum(map(bool, first))
        decided["neighbours"] += len(first) - sum(map(bool, first))
    assert decided["density"] > 1000 and decided["neighbours"] > 500


def test_licenses_are_stated_or_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.txt", "some words\nof no licence here"),
        (3, "a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        (4, "c/y.txt", "words\nLicensed under the Apache License, Version 2.0.\nmore"),
        (5, "c/z.txt", None),
        (6, None, ""),
        (7, "a/z.txt", "the public permission of words"),
    ]
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in licenses.scan(spark, spark.createDataFrame(rows * 2, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", None), 2: ("GPL-3.0", "a/b"), 3: ("GPL-3.0", None), 4: ("Apache-2.0", None), 5: (None, None), 6: (None, None), 7: ("MIT", "a")}


GPL_HEADER = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version. */
int main;"""
MIT_PARAGRAPH = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)


@pytest.mark.parametrize("wrapped", [False, True])
def test_licenses_in_headers_texts_and_identifiers(spark, wrapped):
    rest = " ".join(f"word{i}" for i in range(400))
    said = {
        1: ("// SPDX-License-Identifier: MIT", "MIT"),
        2: ("# spdx-license-identifier: apache-2.0\ncode", "Apache-2.0"),
        3: ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", "GPL-2.0"),
        4: (GPL_HEADER, "GPL-3.0"),
        5: (" ".join(GPL_HEADER.split()) + " " + rest, "GPL-3.0"),
        6: (GPL_HEADER.replace("version 3", "version 2"), "GPL-2.0"),
        7: (GPL_HEADER.replace("General", "Lesser General"), "LGPL-3.0"),
        8: (MIT_PARAGRAPH, "MIT"),
        9: ("Released under the MIT License. " + rest, "MIT"),
        10: ("# This Source Code Form is subject to the terms of\n# the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0"),
        11: ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n" + rest, "GPL-3.0"),
        12: ("SPDX-License-Identifier: Zlib", "Zlib"),
        13: ("a driving license and the permission to park mit dem Auto " + rest, None),
        14: ("We compared the GNU General Public License and others, of which 3 " + rest, None),
    }
    rows = [(i, "x/LICENSE" if i == 11 else f"{i}/file.c", text.replace(" ", "\n# ") if wrapped and i in (8, 9, 10) else text) for i, (text, _) in said.items()]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark, spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {i: name for i, (_, name) in said.items()}


def test_ranks_file_form():
    assert bpe.load_ranks([base64.b64encode(b"ab") + b" 7", b""]) == {b"ab": 7}
    assert np.all([len(k) >= 1 for k in RANKS])
