r"""Licence notices by MinHash bands over overlapping windows, in DataFrame functions only.

Words are runs of [0-9a-z], inner dots and hyphens included, of the lower-cased text; features are
shingles of five words (all words of a shorter notice). A notice of m words is looked for in spans of up to
m + m // 2 words, so that words may be put in (if it may lose no shingle: in spans of m words). Texts are cut in
windows of such a span and m // 2 words more, at a stride of m // 2 (one at least), so any such span lies in one
window whole. A window that holds 0.8 of a notice's shingles has a Jaccard similarity J to it of a fourth at least.
With `BANDS` bands of one MinHash each, such a window meets its notice in some band with probability
1 - (1 - J)^BANDS, over 0.999997. Met notices are verified: the share of the notice's shingles that
are in the window must be 0.8 or more.

Texts and windows that can't hold 0.8 of any notice are passed by before hashing: each notice has anchor
words that occur in more than a fifth of its shingles, so a match has at least one of them.

The notices are a parameter, a mapping of names to texts that is at hand on the driver. Without it, `NOTICES` are looked for. They are
looked for in batches of `BATCH`, those of equal length together. The index has the bands and numbers of notices only; up to `SENT` rows
of it, and of the notices' shingles, are sent to all executors. Beyond, windows are written, their bands alone are shuffled to the
index, and the windows that met a notice are joined with its shingles. A match is a row: doc_id, license,
containment (the best window's) and word (where that window begins; the first if several). A row is
identified by doc_id and text, so repeated rows give one match each per notice; null ids are kept,
null and empty texts match nothing. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareflow.llm.common import written

SHINGLE, CONTAINED, BANDS = 5, 0.8, 48
#: Notices in a batch; rows of fixed size that are broadcast; anchor words that are looked for in the raw text first.
BATCH, SENT, EARLY = 10_000, 100_000, 300
WORD = r"[0-9a-z]+(?:[.-][0-9a-z]+)*"

#: Short notices, the first sentences of public licences, and whole licences that are short.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "LGPL-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "EPL-2.0-text": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "MIT-whole": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-whole": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
        names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
}


def notice_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def notice_shingles(words: list[str]) -> list[str]:
    k = min(SHINGLE, len(words))
    return sorted({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)})


def anchors(words: list[str]) -> list[str]:
    """Long words first, until more than a fifth of the shingles have one."""
    shingles, out = notice_shingles(words), []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(not set(out) & set(s.split()) for s in shingles) < math.ceil(CONTAINED * len(shingles) - 1e-9):
            break
        out.append(w)
    return out


def window_shape(words: list[str]) -> tuple[int, int]:
    """Words in a window, and from one window to the next."""
    m, n = len(words), len(notice_shingles(words))
    exact = math.ceil(CONTAINED * n - 1e-9) == n
    stride = max(1, m // 2)
    return m + (0 if exact else m // 2) + stride, stride


def _shape(words: list[str]) -> tuple[int, int, int, int]:
    return len(words), min(SHINGLE, len(words)), *window_shape(words)


def _notices(spark: SparkSession, notices: dict[str, list[str]]) -> DataFrame:
    rows = [(n, name, *_shape(w)[:3], notice_shingles(w)) for n, (name, w) in enumerate(notices.items())]
    return spark.createDataFrame(rows, "notice int, license string, m int, k int, size int, shingles array<string>")


def shingles(words: Column, k: Column) -> Column:
    """The distinct shingles of k words; none if there are fewer words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))
    made = F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) < k, F.array().cast("array<string>")).otherwise(F.array_distinct(made))


def bands(of: Column) -> Column:
    """A key for each band: its number and the least hash of the shingles under it."""
    least = lambda b: F.array_min(F.transform(of, lambda s: F.xxhash64(s, b)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, least(b)))


def matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: dict[str, str] | None = None) -> DataFrame:
    found = sorted(((name, w) for name, t in (NOTICES if notices is None else notices).items() if (w := notice_words(t))), key=lambda x: (len(x[1]), x[0]))
    batches = [dict(found[at : at + BATCH]) for at in range(0, len(found), BATCH)] or [{}]
    return reduce(DataFrame.unionByName, [_matches(docs, doc_id, text, batch) for batch in batches])


def _matches(docs: DataFrame, doc_id: str, text: str, found: dict[str, list[str]]) -> DataFrame:
    table = _notices(docs.sparkSession, found)
    low = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.lower(F.col(text)).alias("low"))
    chosen: dict[tuple, set] = {}
    for w in found.values():
        chosen.setdefault(_shape(w), set()).update(anchors(w))
    words = sorted(set().union(*chosen.values()))
    may = reduce(or_, [F.contains("low", F.lit(word)) for word in words], F.lit(False)) if len(words) <= EARLY else F.col("low").isNotNull()
    words = low.where(may).select("doc_id", "h", F.regexp_extract_all("low", F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    shape = F.explode(F.array(*[F.struct(
        F.lit(m).alias("m"), F.lit(k).alias("k"), F.lit(size).alias("size"), F.lit(stride).alias("stride"), F.array(*map(F.lit, sorted(own))).alias("anchors"),
    ) for (m, k, size, stride), own in sorted(chosen.items())]) if chosen else F.array().cast("array<struct<m: int, k: int, size: int, stride: int, anchors: array<string>>>"))
    cut = words.select("doc_id", "h", "w", shape.alias("s")).select("doc_id", "h", "w", "s.*")
    n = F.floor(F.greatest(F.size("w") - F.col("size") + F.col("stride") - 1, F.lit(0)) / F.col("stride")).cast("int")
    made = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i * F.col("stride")).cast("int").alias("word"), F.slice("w", (i * F.col("stride")).cast("int") + 1, F.col("size")).alias("part")))
    windows = cut.select("doc_id", "h", "m", "k", "size", F.explode(F.filter(made, lambda x: F.arrays_overlap(x["part"], F.col("anchors")))).alias("x")).select("doc_id", "h", "m", "size", "x.word", shingles(F.col("x.part"), F.col("k")).alias("of")).where(F.size("of") > 0)
    index = table.select("notice", "m", "size", F.explode(bands(F.col("shingles"))).alias("band"))
    names = table.select("notice", "license", "shingles")
    key = ["doc_id", "h", "m", "size", "word"]
    if BANDS * len(found) <= SENT and sum(map(len, found.values())) <= SENT:
        met = windows.select(*key, "of", F.explode(bands(F.col("of"))).alias("band")).join(F.broadcast(index), ["m", "size", "band"]).join(F.broadcast(names), "notice")
    else:
        windows = written(windows, "windows")
        pairs = windows.select(*key, F.explode(bands(F.col("of"))).alias("band")).join(index, ["m", "size", "band"]).select(*key, "notice").distinct()
        own = [F.col(c).alias(f"_{c}") for c in key]
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
        met = windows.join(pairs.select(*own, "notice"), same).join(names, "notice")
    contained = F.size(F.array_intersect("of", "shingles")) / F.size("shingles")
    sure = met.select("doc_id", "h", "license", "word", contained.alias("containment")).where(F.col("containment") >= CONTAINED)
    best = sure.groupBy("doc_id", "h", "license").agg(F.max(F.struct("containment", (-F.col("word")).alias("back"))).alias("b"))
    return best.select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.back")).cast("long").alias("word"))


def oracle(notices: dict[str, str] | None = None) -> str:
    """All windows against all notices, without bands."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for name, text in (NOTICES if notices is None else notices).items():
        w = notice_words(text)
        size, stride = window_shape(w)
        rows.append(f"({quoted(name)}, {min(SHINGLE, len(w))}, {size}, {stride}, [{', '.join(map(quoted, notice_shingles(w)))}])")
    return rf"""
with t(license, k, size, stride, s) as (values {', '.join(rows)}),
d as (select distinct doc_id, text, regexp_extract_all(lower(text), '{WORD}') as w from documents where text is not null),
x as (select doc_id, text, license, k, s, i * stride as word, w[i * stride + 1 : i * stride + size] as p
  from (select *, unnest(range(0, cast(floor(greatest(len(w) - size + stride - 1, 0) / stride) as int) + 1)) as i from d, t where len(w) >= k)),
y as (select doc_id, text, license, word, len(list_intersect(s, list_transform(range(1, len(p) - k + 2), lambda j: array_to_string(p[j : j + k - 1], ' ')))) / len(s) as c from x where len(p) >= k),
b as (select *, row_number() over (partition by doc_id, text, license order by c desc, word) as r from y where c >= {CONTAINED})
select doc_id, license, cast(c as double) as containment, cast(word as bigint) as word from b where r = 1
"""
