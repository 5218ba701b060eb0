"""Substring deduplication by content-defined chunks.

Text bytes (UTF-8) are cut where a gear rolling hash of the last 16 bytes is low, so that a cut
depends on its neighbourhood only and an insertion shifts no later cut. A cut that follows another
within `LEAST` bytes doesn't count, and cuts move on to the next character's beginning; both rules
look at the neighbourhood only, too.

One chunk holds three or four words, and sequences that short recur by chance. So the unit that is
deduplicated is a passage: from each chunk's beginning, the fewest whole chunks that hold `run_words`
words or more (`RUN_WORDS` unless given). Its bytes alone decide where it ends, so two texts that share the chunks share the
passage. Passages are compared by a 64-bit digest of their bytes over all documents. A shared run of
text is found by the passages inside it, which overlap; all but the parts of chunks at both ends is marked. A run of
over 50 words is found but for one in a thousand, one of 25 words in at least nine cases of ten; shorter ones, down to
`run_words` words, only where chunks end near their ends. A passage stays in
the document of the smallest doc_id and is removed elsewhere; so each byte stays in some document.
In scripts without spaces, two characters count as a word. Two different passages have one digest
with a chance of one in 2^64.

Null and empty texts have no chunks. Null ids count as one document, the first. Rows are identified by
doc_id and a 64-bit hash of the text; rows that share a doc_id are one document, and repeated rows get
equal results. Other columns are ignored, or kept by `deduplicated`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.llm.common import unused, written

#: Bytes from one low hash to the next on average; bytes between cuts that count; words in a passage at least.
EVERY, LEAST, RUN_WORDS = 14, 8, 12
LOWEST = -(1 << 63)
GEAR = np.random.default_rng(11).integers(0, 1 << 16, 256, dtype=np.uint16)


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash h' = 2h + gear[byte] in 16 bits at each byte: a sum over the last 16 bytes, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def cuts(data: np.ndarray) -> np.ndarray:
    """The ends of a text's chunks."""
    low = np.flatnonzero(rolling(data) < (1 << 16) // EVERY) + 1
    ends = low[np.diff(low, prepend=-LEAST) >= LEAST]
    for _ in range(3):  # a character has three continuation bytes at most
        ends = ends + ((data[np.minimum(ends, len(data) - 1)] & 0xC0 == 0x80) & (ends < len(data)))
    return np.unique(np.append(ends, len(data)))


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where a character begins of Thai, Lao, Tibetan, Burmese, Khmer, Chinese or Japanese."""
    after = np.append(data[1:], np.uint8(0))
    found = (data >= 0xE3) & (data <= 0xE9) | (data == 0xE0) & (after >= 0xB8) | (data == 0xF0) & (after >= 0xA0)
    return found | (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after >= 0x9E) & (after <= 0x9F))


def passages(text: bytes, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Where each passage begins and ends, and its digest; none from the last chunks, which hold too few words."""
    data = np.frombuffer(text, np.uint8)
    ends = cuts(data)
    starts = np.r_[0, ends[:-1]]
    inside = data > 32
    # halves of words that begin before each byte; a word that the passage's beginning cuts counts in whole
    halves = np.r_[0, np.cumsum(2 * (inside & ~np.r_[False, inside[:-1]]) + unspaced(data))]
    begun = halves[starts + 1] - unspaced(data)[starts] - 2 * inside[starts]
    last = np.searchsorted(halves[ends], begun + 2 * run_words)
    last = np.maximum(last, np.arange(len(ends)))[last < len(ends)]
    starts, ends = starts[: len(last)], ends[last]
    digest = xxhash.xxh3_64_intdigest
    return starts, ends, [digest(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


_FIELDS = {"start": np.int32, "end": np.int32, "digest": np.int64}
_PASSAGES = T.ArrayType(T.StructType([T.StructField(k, T.LongType() if k == "digest" else T.IntegerType()) for k in _FIELDS]))
_UNION = T.StructType([T.StructField("repeated", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def passages_of(run_words: int):
    """A column function: each text's passages, as bytes [start, end), and digest."""

    @F.arrow_udf(_PASSAGES)
    def found(texts: pa.Array) -> pa.Array:
        columns: list[list[np.ndarray]] = [[] for _ in _FIELDS]
        sizes = []
        for text in texts:
            text = text.as_py()
            if not text:
                sizes.append(0)
                continue
            starts, ends, digests = passages(text.encode(), run_words)
            sizes.append(len(starts))
            for column, x in zip(columns, (starts, ends, np.array(digests, np.uint64).view(np.int64)), strict=True):
                column.append(x.astype(np.int64 if column is columns[2] else np.int32))
        arrays = [pa.array(np.concatenate([*c, np.empty(0, kind)]).astype(kind, copy=False)) for c, kind in zip(columns, _FIELDS.values(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.StructArray.from_arrays(arrays, list(_FIELDS)))

    return found


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without overlap that cover the same bytes."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]


@F.arrow_udf(_UNION)
def union(found: pa.Array) -> pa.Array:
    """Of a text's passages: the bytes repeated and removed, and where."""
    offsets, flat = found.offsets.to_numpy(), found.values
    start, end, gone = (np.asarray(flat.field(k).to_numpy(zero_copy_only=False)) for k in range(3))
    repeated, removed, sizes, cut = [], [], [0], []
    for at, to in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        s, e = merged(start[at:to], end[at:to])
        repeated.append(int((e - s).sum()))
        s, e = merged(start[at:to][gone[at:to]], end[at:to][gone[at:to]])
        removed.append(int((e - s).sum()))
        sizes.append(sizes[-1] + len(s))
        cut.append((s, e))
    sides = [pa.array(np.concatenate([*(c[k] for c in cut), np.empty(0, np.int32)]).astype(np.int32)) for k in range(2)]
    spans = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(sides, ["start", "end"]))
    return pa.StructArray.from_arrays([pa.array(repeated, pa.int64()), pa.array(removed, pa.int64()), spans], ["repeated", "removed", "spans"])


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, k, repeated, removed, spans): bytes in repeated passages, bytes to remove, and where, in order.

    k is a hash of the text. Documents without a repeated passage have no row.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("doc_id"), F.xxhash64(F.col(text)).alias("k"), passages_of(run_words)(F.col(text)).alias("p"))
    # in two steps, so that the text does not go along with each of its passages
    rows = written(rows.select("doc_id", "k", F.inline("p")), "passages")
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    shared = written(shared.select("digest", "first"), "shared")
    met = rows.join(shared, "digest").select("doc_id", "k", F.struct("start", "end", (F.col("doc_id") > F.col("first")).alias("gone")).alias("p"))
    # a set, as repeated rows have each passage several times
    return met.groupBy("doc_id", "k").agg(F.collect_set("p").alias("p")).select("doc_id", "k", union("p").alias("u")).select("doc_id", "k", "u.*")


def annotated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """docs with _repeated, _removed (bytes) and _spans (array of start and end), which replace columns of these names."""
    docs = docs.drop("_repeated", "_removed", "_spans")
    # the keys are columns of their own, so that texts are only shuffled where they are used later
    own, h, d, k, u = unused(docs, "id", "hash", "d", "k", "u")
    runs = repeated_runs(docs, doc_id, text, run_words).select(F.col("doc_id").alias(d), F.col("k").alias(k), F.struct("repeated", "removed", "spans").alias(u))
    keyed = docs.withColumns({own: F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)), h: F.xxhash64(F.col(text))})
    joined = keyed.join(runs, (F.col(own) == F.col(d)) & (F.col(h) == F.col(k)), "left")
    zero = F.lit(0).cast("long")
    spans = F.coalesce(F.col(u)["spans"], F.array().cast("array<struct<start: int, end: int>>"))
    return joined.withColumns({"_repeated": F.coalesce(F.col(u)["repeated"], zero), "_removed": F.coalesce(F.col(u)["removed"], zero), "_spans": spans}).drop(own, h, d, k, u)


@F.arrow_udf(T.StringType())
def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts less the spans (bytes)."""
    out = []
    for text, cut in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        if text is None or not cut:
            out.append(text)
            continue
        data, at, kept = text.encode(), 0, []
        for s in cut:
            kept.append(data[at : s["start"]])
            at = s["end"]
        out.append(b"".join([*kept, data[at:]]).decode())
    return pa.array(out, pa.string())


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """docs with texts less what is repeated elsewhere."""
    (whole,) = unused(docs, "row")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = annotated(rows, run_words=run_words).withColumn("text", without(F.col("text"), F.col("_spans")))
    return found.select(*(F.col("text").alias(c) if c == text else F.col(whole)[c].alias(c) for c in docs.columns))
