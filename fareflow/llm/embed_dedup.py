"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors with equal, non-null labels (and equal length) whose cosine, in double precision, reaches a
threshold are linked. Equal vectors are first collapsed to one representative with a count. The rest
are scaled to length one, turned to the principal axes of all vectors (which keeps dot products),
and range-partitioned by label and leading coordinate into tiles of bounded rows and bytes. A tile keeps the
box of its leading coordinates and the largest norm of the others; a pair of tiles whose bound is
below the threshold is left out. The others are compared in blocks of dimensions, the leading ones
first: a pair of vectors is given up as soon as the sum so far plus the product of both suffix norms
can't reach the threshold. Pairs within rounding of the threshold are decided in the original axes.

Neighbouring tiles of a label form a group, and a task compares two groups, so each tile is sent to as many tasks as its label
has groups: `GROUPS`, or more where a group would have over `MOST` tiles. A pair of groups whose bound is below the
threshold isn't sent. A task returns, per vector, how many vectors it links to, and one link per vector of each local
component, never all pairs.

Turning is for speed alone: vectors of over `LONGEST` components, or of other than the `LENGTHS` most frequent lengths, stay in their own axes.

Vectors that are null, empty, zero, or hold a null or non-finite component, and rows without label or
vec_id, link with nothing. Rows that share a vec_id count as one node of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.llm.common import components, written

THRESHOLD = 0.93
#: Vectors and bytes in a tile at most; dimensions in a block; leading coordinates that bound a tile.
TILE, TILE_BYTES, BLOCK, LEAD = 2048, 1 << 20, 16, 4
#: Groups of a label's tiles at least, if it has as many tiles; tiles in a group at most.
GROUPS, MOST = 6, 32
#: Vectors' lengths that are turned: how many, and up to which.
LENGTHS, LONGEST = 16, 1024
#: More than the rounding error of a sum of products of unit vectors.
SLACK = 1e-9


def usable(vector):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the outer products of a partition's unit vectors, by length."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        for d in np.unique(sizes).tolist():
            x = _unit(_matrix(batch.column(0).filter(pa.array(sizes == d)), d))
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        k = np.arange(d * d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(k.astype(np.int64)), pa.array(m.ravel())], ["d", "k", "m"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the eigenvectors of the second moments of all rows, the largest first; for the lengths that are turned."""
    often = vectors.where(F.col("d") <= LONGEST).groupBy("d").count().orderBy(F.desc("count"), "d").limit(LENGTHS)
    lengths = [r["d"] for r in often.collect()]
    sums = vectors.where(F.col("d").isin(lengths)).select("v", "d").mapInArrow(_moments, "d int, k long, m double").groupBy("d", "k").agg(F.sum("m").alias("m"))
    by: dict[int, np.ndarray] = {}
    for r in sums.toPandas().itertuples():  # the square of the vector length, whatever the rows
        by.setdefault(r.d, np.zeros(r.d * r.d))[r.k] = r.m
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in by.items()}


_TILES = T.StructType([
    T.StructField("tile", T.StringType()), T.StructField("label", T.StringType()), T.StructField("d", T.IntegerType()),
    *[T.StructField(f"{side}{k}", T.DoubleType()) for k in range(LEAD) for side in ("lo", "hi")],
    T.StructField("rest", T.DoubleType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("body", T.BinaryType()),
])


def _tiles(rows: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """rows: label (text), d, vec_id, n, v. Ordered by label, length and leading coordinate, then cut."""

    @F.arrow_udf(T.DoubleType())
    def leading(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors))
        sizes = np.array([len(x) for x in vectors])
        for d in np.unique(sizes).tolist():
            x = _unit(_matrix(vectors.filter(pa.array(sizes == d)), d))
            out[sizes == d] = x @ axes[d][:, 0] if d in axes else x[:, 0]
        return pa.array(out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_tiles, held = TaskContext.get().partitionId(), 0, None

        def tile(group: tuple, table: pa.Table) -> pa.RecordBatch:
            nonlocal n_tiles
            label, d = group
            x = _unit(_matrix(table["v"].combine_chunks(), d))
            turned = x @ axes[d] if d in axes else x
            lead = np.zeros((len(x), LEAD))
            lead[:, : min(d, LEAD)] = turned[:, :LEAD]
            n_tiles += 1
            box = {f"{side}{k}": [float(f(lead[:, k]))] for k in range(LEAD) for side, f in (("lo", np.min), ("hi", np.max))}
            rest = float(np.sqrt((turned[:, LEAD:] ** 2).sum(axis=1)).max()) if d > LEAD else 0.0
            row = {"tile": [f"{part:08d}.{n_tiles:08d}"], "label": [label], "d": pa.array([d], pa.int32()), **box, "rest": [rest]}
            row |= {"ids": [table["vec_id"].to_numpy().astype("<i8").tobytes()], "counts": [table["n"].to_numpy().astype("<i8").tobytes()], "body": [x.astype("<f8").tobytes()]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            labels, sizes = held["label"].to_numpy(), held["d"].to_numpy()
            turns = np.flatnonzero((labels[1:] != labels[:-1]) | (sizes[1:] != sizes[:-1])) + 1
            begin = 0
            for end in [*turns.tolist(), len(labels)]:
                size = max(1, min(TILE, TILE_BYTES // (8 * int(sizes[begin])))) if begin < end else 1
                full = end if end < len(labels) else begin + (end - begin) // size * size
                for at in range(begin, full, size):
                    yield tile((labels[at], int(sizes[at])), held.slice(at, min(size, full - at)))
                begin = full
            held = held.slice(begin)
        if held is not None and len(held):
            yield tile((held["label"][0].as_py(), held["d"][0].as_py()), held)

    lead = rows.withColumn("x", leading("v"))
    ordered = lead.repartitionByRange("label", "d", "x", "vec_id").sortWithinPartitions("label", "d", "x", "vec_id")
    return ordered.select("label", "d", "vec_id", "n", "v").mapInArrow(cut, _TILES)


def compared(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float) -> np.ndarray:
    """True where the cosine of a's and b's unit rows reaches the threshold."""
    d = a.shape[1]
    p, q = (a, b) if axes is None else (a @ axes, b @ axes)
    p2, q2 = ((x * x)[:, ::-1].cumsum(axis=1)[:, ::-1] for x in (p, q))  # squared suffix norms
    total = np.zeros((len(a), len(b)))
    i = j = None
    for at in range(0, d, BLOCK):
        to = min(d, at + BLOCK)
        if i is None:
            total += p[:, at:to] @ q[:, at:to].T
            left = total if to == d else total + np.sqrt(p2[:, to])[:, None] * np.sqrt(q2[:, to])[None]
            alive = left >= threshold - SLACK
            n = int(alive.sum())
            if not n:
                return np.zeros(total.shape, bool)
            if n < 0.05 * alive.size:
                i, j = np.nonzero(alive)
                sums = total[i, j]
        else:
            sums = sums + np.einsum("ij,ij->i", p[i, at:to], q[j, at:to])
            left = sums if to == d else sums + np.sqrt(p2[i, to] * q2[j, to])
            keep = left >= threshold - SLACK
            i, j, sums = i[keep], j[keep], sums[keep]
    out = np.zeros(total.shape, bool)
    if i is None:
        i, j = np.nonzero(total >= threshold - SLACK)
        sums = total[i, j]
    sure = sums >= threshold + SLACK
    out[i[sure], j[sure]] = True
    i, j = i[~sure], j[~sure]
    out[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
    return out


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id of these links, the least id of its component among them; ids that are the least have no row."""
    ids, place = np.unique(np.r_[u, v], return_inverse=True)
    i, j = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


#: Rows of a task's result: a vector with its links here, or a link to the least vector of its component.
_FOUND = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("links", T.LongType())])


def _bound(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """The largest cosine that vectors of two boxes can have, for each pair."""
    out = a["rest"][:, None] * b["rest"][None]
    for k in range(LEAD):
        out = out + np.max([a[f"{s}{k}"][:, None] * b[f"{t}{k}"][None] for s in ("lo", "hi") for t in ("lo", "hi")], axis=0)
    return out


def _pair_links(axes: dict[int, np.ndarray], threshold: float):
    def found(table: pa.Table) -> pa.Table:
        d, left, right = (table[c][0].as_py() for c in ("d", "left", "right"))
        table = table.sort_by("tile")
        group = table["group"].to_numpy()
        own = axes.get(d)
        boxes = {c: table[c].to_numpy() for c in ("rest", *(f"{side}{k}" for side in ("lo", "hi") for k in range(LEAD)))}
        may = _bound(boxes, boxes) >= threshold - SLACK
        bodies, ids, counts = (table[c].combine_chunks() for c in ("body", "ids", "counts"))
        read = lambda column, k, kind: np.frombuffer(column[k].as_buffer(), kind)
        links = [np.zeros(len(read(ids, k, "<i8")), np.int64) for k in range(len(table))]
        stars: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for x in np.flatnonzero(group == left).tolist():
            a, ids_a, counts_a = read(bodies, x, "<f8").reshape(-1, d), read(ids, x, "<i8"), read(counts, x, "<i8")
            for y in np.flatnonzero((group == right) & may[x]).tolist():
                if left == right and y < x:
                    continue
                b, ids_b, counts_b = read(bodies, y, "<f8").reshape(-1, d), read(ids, y, "<i8"), read(counts, y, "<i8")
                hits = compared(a, b, own, threshold)
                if x == y:
                    np.fill_diagonal(hits, False)
                links[x] += hits @ counts_b
                if x != y:
                    links[y] += counts_a @ hits
                i, j = np.nonzero(hits)
                stars.append(_stars(ids_a[i], ids_b[j]))
                held += len(stars[-1][0])
                if held > 1 << 20:  # one link a vector is enough
                    stars = [_stars(*(np.concatenate([s[k] for s in stars]) for k in range(2)))]
                    held = 0
        u, v = _stars(*(np.concatenate([np.empty(0, np.int64), *(s[k] for s in stars)]) for k in range(2)))
        all_ids, all_links = np.concatenate([read(ids, k, "<i8") for k in range(len(table))]), np.concatenate(links)
        linked = all_links > 0
        n = int(linked.sum())
        return pa.table([
            pa.array(np.r_[all_ids[linked], u]), pa.array(np.r_[np.zeros(n, np.int64), v], mask=np.r_[np.ones(n, bool), np.zeros(len(u), bool)]),
            pa.array(np.r_[all_links[linked], np.zeros(len(u), np.int64)])], ["u", "v", "links"])

    return found


def _dealt(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tiles' groups, and the pairs of groups with the largest cosine that they can hold."""
    meta = tiles.drop("ids", "counts", "body")
    # as many rows as a label has tiles
    own = W.partitionBy("label", "d")
    groups = F.greatest(F.least(F.lit(GROUPS), F.col("n")), F.ceil(F.col("n") / MOST))
    placed = meta.withColumns({"n": F.count("*").over(own), "at": F.row_number().over(own.orderBy("tile")) - 1})
    placed = placed.select("*", F.floor(F.col("at") * groups / F.col("n")).alias("group"))
    box = [f(c).alias(c) for k in range(LEAD) for c, f in ((f"lo{k}", F.min), (f"hi{k}", F.max))]
    boxes = placed.groupBy("label", "d", "group").agg(*box, F.max("rest").alias("rest"))
    a, b = boxes.alias("a"), boxes.alias("b")
    bound = F.col("a.rest") * F.col("b.rest")
    for k in range(LEAD):
        bound = bound + F.greatest(*[F.col(f"a.{s}{k}") * F.col(f"b.{t}{k}") for s in ("lo", "hi") for t in ("lo", "hi")])
    return placed, a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.group") <= F.col("b.group"))).select(
        F.col("a.label").alias("label"), F.col("a.d").alias("d"), F.col("a.group").alias("left"), F.col("b.group").alias("right"), bound.alias("bound"))


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept (it is its component's smallest id)."""
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fits = usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    hashed = rows.where(fits).withColumn("h", F.xxhash64("v"))
    distinct = written(hashed.groupBy("label", "h", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).withColumn("d", F.size("v")), "distinct")
    axes = principal_axes(distinct)
    tiles = written(_tiles(distinct.select("label", "d", "vec_id", "n", "v"), axes), "tiles")
    placed, pairs = _dealt(tiles)
    pairs = pairs.where(F.col("bound") >= threshold - SLACK).drop("bound")
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("left", "right"))).alias("group"))
    sent = placed.select("tile", "label", "d", "group").join(sides, ["label", "d", "group"]).select("tile", "group", "left", "right")
    both = tiles.join(sent, "tile")
    found = written(both.groupBy("label", "d", "left", "right").applyInArrow(_pair_links(axes, threshold), _FOUND), "found")
    links = found.where("v is null").groupBy(F.col("u").alias("vec_id")).agg(F.sum("links").alias("links"))
    parts = components(found.where("v is not null").select("u", "v"))
    by_class = distinct.select("label", "h", "v", "vec_id", "n").join(links, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    by_class = written(by_class.select("label", "h", F.col("v").alias("cv"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "classes")
    linked = hashed.join(by_class, ["label", "h"]).where(F.col("v") == F.col("cv")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(fits, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
