"""SimHash near-duplicates by a hierarchical index over Gray-ordered fingerprints.

Words are maximal runs without ASCII white space, A-Z lower-cased; features are the space-joined
shingles of three words with repeats (fewer words: the whole sequence). A feature's hash is XXH64 of
its UTF-8 bytes with seed 42; a fingerprint bit is 1 if set in over half the hashes. Null texts and
texts without words have the fingerprint zero, which links like any other.

All distinct fingerprints are sorted by Gray rank, in which neighbours share their leading bits, and
range-partitioned into leaves of about `LEAF`. A leaf holds the bits that all its fingerprints share;
upper nodes hold the bits that all below them share, less those of their parent. A query adds up the
differing bits on its way down and leaves out a node, with all below it, when the sum is over the limit.
The upper nodes, `MOST_LEAVES` leaves at most, go to every task: there each fingerprint is sent on to
the later leaves that are not ruled out, and meets a leaf's fingerprints, which are indexed in the same
way down to single fingerprints. A leaf's queries are dealt to `SALTS` tasks by a hash, so that a dense
region is shared out. A batch gives one link per fingerprint that has a partner (to the least of its
local component), not all pairs. Copies share one fingerprint and are never expanded.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.llm.common import components, written

SHINGLE, SEED, LIMIT = 3, 42, 2
#: Fingerprints in a leaf, while there are no more than so many leaves; tasks that share a leaf's queries.
LEAF, MOST_LEAVES, SALTS = 1024, 1 << 14, 4
#: Children of a node.
FAN = 8


def _hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:n], last, strict=True)), np.uint64, n)


def fingerprint_of(text: str | None) -> int:
    """The fingerprint, as an unsigned integer."""
    h = _hashes((text or "").encode())
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """The fingerprint's 64 bits as a signed long."""
    return pa.array(np.array([fingerprint_of(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


def hex16(c):
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the reflected Gray order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayTree:
    """Nodes over Gray-ordered bit patterns. A node holds the bits that all below it share, less those its parent holds."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray):
        """pattern and mask of the leaves, in Gray order; a fingerprint is a leaf that holds all bits."""
        self.levels, self.compared = [(np.arange(len(pattern)), pattern & mask, mask)], 0
        while len(self.levels[-1][1]) > 1:
            _, pattern, mask = self.levels[-1]
            begins = np.arange(0, len(pattern), FAN)
            own = np.arange(len(pattern)) // FAN
            up = np.bitwise_and.reduceat(mask & ~(pattern ^ pattern[begins][own]), begins)
            self.levels.append((begins, pattern[begins] & up, up))

    def reach(self, prints: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) positions where a query differs from the leaf's bits in `limit` at most.

        Differing bits are added up on the way down; where the sum is over the limit, a node goes with all below it.
        """
        _, pattern, mask = self.levels[-1]
        differ = np.bitwise_count((prints ^ pattern[0]) & mask[0]).astype(np.int64)
        query = np.flatnonzero(differ <= limit)
        node, differ = np.zeros(len(query), np.int64), differ[query]
        for (begins, _, parent), (_, pattern, mask) in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
            n = np.diff(np.r_[begins, len(pattern)])[node]
            rows = np.repeat(np.arange(len(node)), n)
            child = begins[node][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            q = query[rows]
            total = differ[rows] + np.bitwise_count((prints[q] ^ pattern[child]) & mask[child] & ~parent[node][rows])
            self.compared += len(rows)
            keep = total <= limit
            query, node, differ = q[keep], child[keep], total[keep]
        return query, node


ALL = ~np.uint64(0)


def _stars(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its local component), as signed, for those with a partner."""
    signed = prints.view(np.int64)
    order = np.argsort(signed, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    label, before = place.copy(), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = np.minimum(label, label[order[label]])
    far = label != place
    return signed[far], signed[order[label[far]]]


def _routed(leaves: np.ndarray, pattern: np.ndarray, mask: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sends each fingerprint to its own leaf, and on to the later leaves that the upper nodes don't rule out."""
    tree = GrayTree(pattern, mask)

    def made(target: np.ndarray, salt: np.ndarray, own: bool, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(leaves[target].astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(np.full(len(fp), own)), pa.array(fp)], ["target", "salt", "own", "fp"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 12):
            leaf, fp = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.slice(at, 1 << 12).columns)
            at_leaf = np.searchsorted(leaves, leaf)
            for salt in range(SALTS):
                yield made(at_leaf, np.full(len(fp), salt), True, fp)
            query, target = tree.reach(fp.view(np.uint64))
            later = target > at_leaf[query]
            query, target = query[later], target[later]
            yield made(target, _salt(fp[query]), False, fp[query])


def _salt(fp: np.ndarray) -> np.ndarray:
    """A share of the queries of a leaf. The multiplier spreads fingerprints that differ in few bits."""
    return (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(SALTS)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows by target and salt, a leaf's own fingerprints before its queries, and gives links (u, v)."""
    key, own, tree, members = None, [], None, np.empty(0, np.uint64)

    def links(queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(64, (1 << 20) // max(1, len(members)))
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            i, j = tree.reach(some)
            differs = some[i] != members[j]
            if differs.any():
                prints, place = np.unique(np.r_[some, members], return_inverse=True)
                u, v = _stars(prints, place[i[differs]], place[len(some) + j[differs]])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def built(salt: int) -> Iterator[pa.RecordBatch]:
        """The leaf's tree; its own fingerprints of this salt are queries, too."""
        nonlocal tree, members
        members = np.concatenate(own).view(np.uint64)
        members = members[np.argsort(gray_rank(members))]
        tree = GrayTree(members, np.full(len(members), ALL))
        yield from links(members[_salt(members.view(np.int64)) == salt])

    for batch in batches:
        target, salt, is_own, fp = (np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns)
        turns = np.flatnonzero((np.diff(target) != 0) | (np.diff(salt) != 0) | (np.diff(is_own.astype(np.int8)) != 0)) + 1
        for s, e in zip([0, *turns.tolist()], [*turns.tolist(), len(fp)], strict=True):
            if s == e:
                continue
            if key != (target[s], salt[s]):
                if own:
                    yield from built(key[1])
                key, own, tree = (target[s], salt[s]), [], None
            if is_own[s]:
                own.append(fp[s:e])
            else:
                if tree is None:
                    yield from built(key[1])
                    own = []
                yield from links(fp[s:e].view(np.uint64))
    if own:
        yield from built(key[1])


@F.arrow_udf(T.LongType())
def gray_order(prints: pa.Array) -> pa.Array:
    """A long that sorts as the Gray rank does."""
    rank = gray_rank(prints.to_numpy().view(np.uint64))
    return pa.array((rank ^ np.uint64(1 << 63)).view(np.int64))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) within two differing bits."""
    n_leaves = max(1, min(MOST_LEAVES, -(-prints.count() // LEAF)))
    ordered = prints.select("fp", gray_order("fp").alias("rank")).repartitionByRange(n_leaves, "rank").select(F.spark_partition_id().alias("leaf"), "fp")
    ordered = written(ordered, "leaves")
    shared = ordered.groupBy("leaf").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any"))
    found = sorted((r["leaf"], r["ones"], r["any"]) for r in shared.collect())  # MOST_LEAVES rows at most
    leaves, ones, any_ = (np.array([r[k] for r in found], np.int64) for k in range(3))
    mask = ~(ones ^ any_).view(np.uint64)
    route = functools.partial(_routed, leaves, ones.view(np.uint64), mask)
    routed = ordered.mapInArrow(route, "target int, salt int, own boolean, fp long")
    dealt = routed.repartition("target", "salt").sortWithinPartitions("target", "salt", F.desc("own"))
    return dealt.mapInArrow(_search, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", roots: bool = False) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id, the smallest doc_id of its component.

    Null ids get a component but never name one, unless all its ids are null. Repeated ids keep a row each.
    Components without an id share the name null, and a repeated id may name several; with `roots`, rows also
    have root, the least fingerprint of the component, which tells components apart, and h, the text's hash.
    """
    hashed = [F.xxhash64(F.col(text)).alias("h")] if roots else []
    more = ["root"] if roots else []
    rows = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp"), *hashed), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = components(fingerprint_links(distinct.select("fp")))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    rooted = written(rooted, "roots")
    least = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = written(rooted.join(least, "root").select("fp", "component_id", *more), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", *more, *(["h"] if roots else []))
