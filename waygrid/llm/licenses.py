"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest licensed directory.

A file states a licence in one of three ways, each scored as the cosine of sparse TF-IDF vectors of words:

* a line that uses a licensing word is compared with short statements (``TEMPLATES``);
* at each ``PIVOT`` word, across line ends and comment marks, the words around it are compared with the headers, texts
  and titles in ``PASSAGES``, each with as many words as it has itself; titles count in the first ``HEAD`` words of
  licence files only, where whole licence texts begin with them;
* an ``SPDX-License-Identifier`` line states each of its identifiers, with score 1.

The best score at or above ``LEAST`` gives the file's licence.  A file without one takes the licence of the nearest
ancestor directory (its own first) that holds a licence file.  All of it is joins and aggregations; the template tables
have a fixed size and are the only sides that are broadcast.  The SQL twin has the lines alone, which is all that the
driver's tables hold.

Cases: a null or empty text states nothing; words are compared in lower case over letters and digits; equal
scores go to the alphabetically first licence; several licence files of one directory count by score, then name;
a null path inherits nothing; repeated rows count once; an empty table gives an empty one; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Smallest cosine at which a line states a licence.
LEAST = 0.6

# Usual one-line statements of public licences.
TEMPLATES = (
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("BSD-3-Clause", "use of this source code is governed by a bsd style license"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("GPL-2.0", "licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
)
# Words without which no line can reach a template, and names of licence files.
ANCHORS = r"licen[sc]e|permission|redistribution|public domain"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"


#: Words that passages are laid at, and how many words of a licence file can hold its title.
PIVOT, HEAD = r"^(licensed|license|permission|redistribution|unencumbered|dedicated|cc0|[al]?gpl(v?[0-9])?)$", 60
_GNU = (("GPL", "gnu general", "gpl"), ("LGPL", "gnu lesser general", "lgpl"), ("AGPL", "gnu affero general", "agpl"))
_KINDS = (("GPL-2.0", "2"), ("GPL-3.0", "3"), ("LGPL-2.1", "2 1"), ("LGPL-3.0", "3"), ("AGPL-3.0", "3"))


def _gnu() -> list[tuple[str, str, str]]:
    """Passages: the usual headers of the GNU licences."""
    found = []
    for name, version in _KINDS:
        _, full, short = next(x for x in _GNU if name.startswith(x[0]))
        long = f"{full} public license"
        needs = f"{full} public {version}" + (" -lesser -affero" if name.startswith("GPL") else "")
        found += [
            *((name, needs, f"this {what} is free software you can redistribute it and or modify it under the terms of the {long} as published by the free software foundation either version {version} of the license or at your option any later version") for what in ("program", "library", "file")),
            (name, needs, f"it under the terms of the {long} version {version} as published by the free software foundation"),
            (name, needs, f"under the terms of the {long} version {version}"),
            (name, needs, f"under the {long} version {version}"),
            (name, f"{short} {version}", f"under the {short} version {version}"),
            (name, f"{short} {version}", f"licensed under {short} {version}"),
        ]
        if " " not in version:
            found += [
                (name, f"{short} v{version}", f"under the {short} v{version}"),
                (name, f"{short}v{version}", f"under the {short}v{version}"),
                (name, f"{short}v{version}", f"licensed under {short}v{version}"),
            ]
    return found


_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "{0} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "{1} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_NEITHER = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"

# Fixed values: ``(licence, words it must have and, marked ``-``, lack, passage)``: headers and whole texts of public licences.
PASSAGES = (
    ("Apache-2.0", "apache 2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("Apache-2.0", "apache 2", "under the apache license version 2 0"),
    ("Apache-2.0", "apache 2", "under the apache license 2 0"),
    ("Apache-2.0", "apache 2", "under the apache 2 0 license"),
    ("BSD-2-Clause", "redistribution binary reproduce", _BSD.format("1", "2") + _AS_IS),
    ("BSD-2-Clause", "redistribution binary reproduce", _BSD.format("", "") + _AS_IS),
    ("BSD-2-Clause", "bsd 2", "under the bsd 2 clause license"),
    ("BSD-3-Clause", "redistribution binary endorse", _BSD.format("1", "2") + "3 " + _NEITHER),
    ("BSD-3-Clause", "redistribution binary endorse", _BSD.format("", "") + _NEITHER),
    ("BSD-3-Clause", "bsd 3", "under the bsd 3 clause license"),
    ("BSD-3-Clause", "bsd style governed", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("BSD-3-Clause", "bsd style governed", "use of this source code is governed by a bsd style license"),
    ("CC0-1.0", "cc0 1", "to the public domain under cc0 1 0"),
    ("CC0-1.0", "creative commons cc0 1", "dedicated to the public domain under the creative commons cc0 1 0 universal"),
    *((name, kind, f"licensed under {kind}") for name, kind in (("CC-BY-4.0", "cc by 4 0"), ("CC-BY-NC-4.0", "cc by nc 4 0"), ("CC-BY-SA-4.0", "cc by sa 4 0"))),
    *(
        (name, f"creative commons attribution {kind} 4", f"licensed under {the} creative commons attribution {kind} 4 0 international license")
        for name, kind in (("CC-BY-4.0", ""), ("CC-BY-NC-4.0", "noncommercial"), ("CC-BY-NC-4.0", "non commercial"), ("CC-BY-SA-4.0", "sharealike"), ("CC-BY-SA-4.0", "share alike"))
        for the in ("a", "the")
    ),
    ("ISC", "permission fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "isc", "under the isc license"),
    (
        "MIT",
        "permission charge sublicense",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    ("MIT", "permission charge obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MIT", "mit", "under the mit license"),
    ("MIT", "mit", "under the terms of the mit license"),
    ("MPL-2.0", "mozilla 2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("MPL-2.0", "mozilla 2", "subject to the terms of the mozilla public license v 2 0"),
    ("MPL-2.0", "mozilla 2", "under the mozilla public license 2 0"),
    ("MPL-2.0", "mozilla 2", "under the mozilla public license version 2 0"),
    ("Unlicense", "unencumbered domain", "this is free and unencumbered software released into the public domain"),
    *_gnu(),
)
# The same for titles of licence files.
TITLES = (
    ("Apache-2.0", "apache 2", "apache license version 2 0"),
    ("BSD-2-Clause", "bsd 2", "bsd 2 clause license"),
    ("BSD-3-Clause", "bsd 3", "bsd 3 clause license"),
    ("ISC", "isc", "isc license"),
    ("MIT", "mit", "mit license"),
    ("MPL-2.0", "mozilla 2", "mozilla public license version 2 0"),
    *((name, f"{next(x[1] for x in _GNU if name.startswith(x[0]))} public {version}" + (" -lesser -affero" if name.startswith("GPL") else ""), f"{next(x[1] for x in _GNU if name.startswith(x[0]))} public license version {version}") for name, version in _KINDS),
)
# What a text must have for the two, and an SPDX line.
PASSAGE_ANCHORS = r"licen[sc]e|permission|redistribution|unencumbered|public domain|gpl"
SPDX = r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)"


def _weights(templates) -> tuple[list[tuple], float]:
    """``(word, template, licence, idf, weight)`` with weights of unit length, and the idf of an unknown word."""
    docs = [Counter(re.findall(r"[a-z0-9]+", text)) for _, text in templates]
    df = Counter(w for d in docs for w in d)
    idf = {w: round(math.log((1 + len(docs)) / (1 + n)) + 1, 6) for w, n in df.items()}
    rows = []
    for i, (d, (name, _)) in enumerate(zip(docs, templates)):
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in d.items()))
        rows += [(w, i, name, idf[w], round(n * idf[w] / length, 6)) for w, n in sorted(d.items())]
    return rows, round(math.log(1 + len(docs)) + 1, 6)


def template_weights() -> tuple[list[tuple], float]:
    """The weights of the statements that fill a line."""
    return _weights(TEMPLATES)


def line_licenses(spark: SparkSession, files: DataFrame, key: str, text: str) -> DataFrame:
    """``key, license, score`` of lines against ``TEMPLATES``."""
    rows, unknown = template_weights()
    weights = F.broadcast(spark.createDataFrame(rows, "word string, template int, license string, idf double, weight double"))
    lines = F.filter(F.split(F.lower(text), "\n"), lambda line: line.rlike(ANCHORS))
    lines = files.select(files[key].alias("key"), F.posexplode(lines).alias("line", "said"))
    words = lines.select("key", "line", F.filter(F.split("said", "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    words = words.select("key", "line", "words", F.explode(F.array_distinct("words")).alias("word"))
    tf = F.size(F.filter("words", lambda w: w == F.col("word")))
    words = words.select("key", "line", "word", tf.alias("tf"))
    idf = F.broadcast(spark.createDataFrame(sorted({(r[0], r[3]) for r in rows}), "word string, idf double"))
    lengths = words.join(idf, "word", "left").groupBy("key", "line").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(unknown)), F.lit(2)))).alias("length"))
    dots = words.join(weights, "word").groupBy("key", "line", "template", "license").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"))
    scores = dots.join(lengths, ["key", "line"]).select("key", "license", F.round(F.col("dot") / F.col("length"), 4).alias("score"))
    return scores.filter(F.col("score") >= LEAST)


def passage_licenses(spark: SparkSession, files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """``key, license, score`` of the words around pivots against ``PASSAGES`` and ``TITLES``."""
    passages = [*((*p, False) for p in PASSAGES), *((*p, True) for p in TITLES)]
    rows, unknown = _weights([(p[0], p[2]) for p in passages])
    laid = []
    for i, (name, needs, passage, title) in enumerate(passages):
        words = passage.split()
        at = next(at for at, word in enumerate(words) if re.match(PIVOT, word))
        laid.append((words[at], i, name, [x for x in needs.split() if x[0] != "-"], [x[1:] for x in needs.split() if x[0] == "-"], at, len(words), title))
    laid = F.broadcast(spark.createDataFrame(laid, "pivot string, template int, license string, needs array<string>, lacks array<string>, before int, n int, title boolean"))
    texts = files.select(files[key].alias("key"), F.coalesce(files[path].rlike(LICENSE_FILE), F.lit(False)).alias("named"), F.lower(files[text]).alias("said"))
    texts = texts.filter(F.col("said").rlike(PASSAGE_ANCHORS))
    words = F.filter(F.split(F.regexp_replace("said", "licence", "license"), "[^a-z0-9]+"), lambda w: w != "")
    texts = texts.select("key", "named", words.alias("words"))
    pivots = F.filter(F.transform("words", lambda w, i: F.when(w.rlike(PIVOT), F.struct(i.alias("at"), w.alias("pivot")))), lambda x: x.isNotNull())
    places = texts.select("key", "named", "words", F.explode(pivots).alias("p")).select("key", "named", "words", "p.at", "p.pivot").join(laid, "pivot")
    start = F.col("at") - F.col("before")
    places = places.filter(~F.col("title") | F.col("named") & (F.col("at") < HEAD))
    window = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("n") + F.least(start, F.lit(0)))
    places = places.select("key", "at", "template", "license", "needs", "lacks", window.alias("window"))
    places = places.filter((F.size(F.array_except("needs", "window")) == 0) & ~F.arrays_overlap("lacks", "window"))
    # The same words in the same passage score the same, in whichever file and however often.
    places = places.select("key", "template", "license", F.array_sort("window").alias("window"))
    words = places.select("template", "window").distinct().select("template", "window", F.explode("window").alias("word")).groupBy("template", "window", "word").agg(F.count("*").alias("tf"))
    idf = F.broadcast(spark.createDataFrame(sorted({(r[0], r[3]) for r in rows}), "word string, idf double"))
    weights = F.broadcast(spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], "word string, template int, weight double"))
    words = words.join(idf, "word", "left").join(weights, ["word", "template"], "left")
    value = F.col("tf") * F.coalesce("idf", F.lit(unknown))
    sums = words.groupBy("template", "window").agg(F.sum(value * F.coalesce("weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(value * value)).alias("length"))
    scores = sums.select("template", "window", F.round(F.col("dot") / F.col("length"), 4).alias("score")).filter(F.col("score") >= LEAST)
    return places.join(scores, ["template", "window"]).select("key", "license", "score")


def spdx_licenses(files: DataFrame, key: str, text: str) -> DataFrame:
    """``key, license, score`` of the identifiers in SPDX lines; ``-only`` and ``-or-later`` are one licence, exceptions none."""
    lines = files.select(files[key].alias("key"), F.explode(F.regexp_extract_all(files[text], F.lit(SPDX), F.lit(1))).alias("said"))
    plain = F.regexp_replace("said", r"(?i)\bwith\s+[A-Za-z0-9.-]+", " ")
    ids = lines.select("key", F.explode(F.regexp_extract_all(plain, F.lit(r"([A-Za-z0-9][A-Za-z0-9.+-]*)"), F.lit(1))).alias("id"))
    ids = ids.filter(~F.lower("id").isin("or", "and", "none", "noassertion")).select("key", F.regexp_replace("id", r"(?i)(-only|-or-later|\+)$", "").alias("id"))
    names = sorted({name for name, *_ in (*TEMPLATES, *PASSAGES, *TITLES)})
    known = F.create_map(*(F.lit(x) for name in names for x in (name.lower(), name)))
    return ids.select("key", F.coalesce(F.element_at(known, F.lower("id")), "id").alias("license"), F.lit(1.0).alias("score"))


def stated_licenses(spark: SparkSession, files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """``key, license, score`` of files that state one."""
    said = line_licenses(spark, files, key, text).unionByName(passage_licenses(spark, files, key, path, text)).unionByName(spdx_licenses(files, key, text))
    best = said.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    return best.select("key", "best.license", (-F.col("best.s")).alias("score"))


def directory(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(spark: SparkSession, files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """``key, license, score, inherited_from`` of every file; ``inherited_from`` is null where it states its own."""
    stated = written(stated_licenses(spark, files, key, path, text), "licenses").withColumnRenamed("key", "stated_key")
    placed = files.select(files[key].alias("key"), files[path].alias("path")).distinct()
    known = placed.join(stated, F.col("key") == F.col("stated_key"), "left").drop("stated_key")
    licensed = known.filter(F.col("path").rlike(LICENSE_FILE) & F.col("license").isNotNull())
    licensed = licensed.groupBy(directory("path").alias("at")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    licensed = licensed.select("at", F.col("best.license").alias("theirs"))
    # Ancestors of a path: each prefix of its directories, the root being the empty one.
    steps = F.split(directory("path"), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    bare = known.filter("license is null and path is not null").select("key", "path", F.posexplode(F.array_distinct(ancestors)).alias("depth", "at"))
    nearest = bare.join(licensed, "at").groupBy("key", "path").agg(F.max(F.struct("depth", "at", "theirs")).alias("near"))
    nearest = nearest.select(F.col("key").alias("k"), F.col("path").alias("p"), "near.at", "near.theirs")
    out = known.join(nearest, F.col("key").eqNullSafe(F.col("k")) & (F.col("path") == F.col("p")), "left")
    return out.select(F.col("key").alias(key), F.coalesce("license", "theirs").alias("license"), "score", F.col("at").alias("inherited_from"))
