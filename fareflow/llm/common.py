"""Shared helpers: the shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Unicode White_Space; Python's isspace also takes four control characters.
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]
BLANKS = "".join(SPACES)
OTHERS = [c for c in SPACES if c not in " \n"]


def body_of(text: str) -> tuple[str, str] | None:
    """A text with a space before each of its words but the first, and the white space at the end.

    A byte-level pattern always begins a new match at a space or line feed, as long as no other white space is next to it. A
    word that begins with a line feed gets a space before that. Where a text has other white space, or three line feeds in a
    row, only its own spaces count. None where a space is next to white space.
    """
    if any(f" {c}" in text or f"{c} " in text for c in SPACES if c in text):
        return None
    body = text.rstrip(BLANKS)
    tail = text[len(body) :]
    if "\n" in body and "\n\n\n" not in body and not any(c in body for c in OTHERS):
        body = body.replace("\n", " \n")
    return body, tail


def words_of(text: str) -> tuple[str, list[str], str] | None:
    """A text cut at the spaces of `body_of`: the first word, the rest, and the white space at the end.

    A word of the rest begins with its line feed, or else follows a space. None where a space is next to white space.
    """
    if (cut := body_of(text)) is None:
        return None
    first, *rest = cut[0].split(" ")
    return first, rest, cut[1]


#: Entries in a generation of a memo.
CACHE = 150_000


class Memo(dict):
    """Bytes by string. When full, what wasn't used since it was last full is forgotten, so its memory is bounded."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.before = make, size, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 64:
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.before = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Only a local session, as in tests, may go without: it has a temp folder then."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/fareflow"
    return f"{base.rstrip('/')}/fareflow-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage.

    The table is on shared storage, so a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has; Spark's names don't tell cases apart."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        made = f"_{name}"
        while made in taken:
            made = f"_{made}"
        taken.add(made)
        out.append(made)
    return out


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows, and of at most so many bytes of one text column where rows allow."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > begin and (k - begin == rows or held + n > size):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if batch.num_rows:
        yield batch.slice(begin)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (u, v), by alternating large-star and small-star rounds.

    Returns (node, component) for each node that has an edge to another one; component is the least
    node reachable. Each half-round is one aggregate for the least neighbour and one join of two
    written tables, so that a hot node's rows can be split by the adaptive skew join; the number of
    rounds grows with the logarithm of the longest chain. Edges with a null end are ignored.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written: the larger end points to the smaller one
    pairs = written(pairs.where("u is not null and v is not null and u <> v").distinct(), "edges")
    before = _state(pairs)
    while before[0]:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least")
        large = pairs.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small")
        after = _state(pairs)
        if after == before:
            break
        before = after
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
