"""Token ids as Arrow files of fixed-size lists.

`write` encodes each whole text, appends an end id, and lays the ids of a partition's documents end
to end, in ascending order of doc_id. Each Arrow file holds record batches of two fixed-size-list
columns of equal length: `tokens` and `mask` (true: a real id, false: padding at the end of the
file). A file can be memory-mapped, and any sequence is a zero-copy slice of its batch. Beside each
file, an index file has doc_id, start (in the file) and n_tokens per document. The folder's manifest
has one row per file with the number of ids before it, so starts are global.

Rows are ordered by doc_id, then by the text's hash, then by text; null ids come first, null texts count as empty. Repeated
rows are written once each. An empty table gives an empty manifest and no rows. Files of attempts that failed
are not in the manifest, so they are never read.
"""

from __future__ import annotations

import functools
import os
import posixpath
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareflow.llm.common import OTHERS, body_of, shared_dir, slices

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE, BATCH = 2048, 64
#: Words in the memo, and rows and bytes of text that are encoded together.
CACHE, ROWS_AT_ONCE, BYTES_AT_ONCE = 500_000, 4096, 1 << 23
#: Ends of words that are never in one piece with a letter.
MARKS = ".,;:!?$&%#*)]"
MANIFEST = "part int, path string, first_ids long, n_ids long, n_docs long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


class Encoder:
    """The tokenizers library, with a memo of words.

    The byte-level pre-tokenizer always begins a new piece at a space or a line feed that stands between two
    characters other than white space; so texts are cut there. The words of many texts are numbered by Arrow, and the
    distinct ones looked up in the memo, which is Arrow too. Those that are not known yet are encoded together, as one
    text: a word's ids are those from one token that begins with a space or line feed to the next. White space at a text's end is a piece of its own, and so are the marks that end
    a word. Texts that hold an added token (such as an end mark) go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        heads = tuple(self.tokenizer.id_to_token(self._ids(c)[0]) for c in " \n")
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith(heads) for i in range(self.tokenizer.get_vocab_size())])
        # the memo: words, where the ids of each begin, how many it has, and all ids
        self.known, self.starts, self.sizes, self.ids = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.marks: dict[str, bytes] = {}

    def _all_ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self._all_ids([text])[0], "<u4")

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) > 10_000:
                self.marks.clear()
            self.marks[mark] = self._all_ids([mark])[0]
        return self.marks[mark]

    def _encoded(self, words: list[str], odd: set[str]) -> list[bytes]:
        """The ids of distinct words; odd ones hold white space."""
        # marks after a letter are a piece of their own
        stems = [w.rstrip(MARKS) for w in words]
        stems = [s if s[-1:].isalpha() else w for w, s in zip(words, stems, strict=True)]
        found, asked = {}, set(stems)
        plain = [*asked.difference(odd)]
        if plain:
            ids = self._ids("".join([w if w[:1] == "\n" else f" {w}" for w in plain]))
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(plain):
                raw, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                found.update((w, raw[s:e]) for w, s, e in zip(plain, at[:-1], at[1:], strict=True))
            else:
                odd = odd.union(plain)
        alone = [*asked.intersection(odd)]
        if alone:
            found.update(zip(alone, self._all_ids([w if w[:1] == "\n" else f" {w}" for w in alone]), strict=True))
        return [found[w] if w == s else found[s] + self._mark(w[len(s) :]) for w, s in zip(words, stems, strict=True)]

    def _places(self, words: pa.Array, spaced: bool) -> np.ndarray:
        """The places of distinct words in the memo, after those that it lacks are added. When it is full, only these words stay."""
        at = pc.index_in(words, value_set=self.known)
        new, at = words.filter(at.is_null()), at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        met = at >= 0
        if len(self.known) + len(new) > CACHE:
            used, at[met] = np.unique(at[met], return_inverse=True)
            self.known, sizes = self.known.take(pa.array(used)), self.sizes[used]
            self.ids = self.ids[_spans(self.starts[used], sizes)]
            self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        at[~met] = len(self.known) + np.arange(len(new))
        texts = new.to_pylist()
        encoded = self._encoded(texts, {w for w in texts if len(w.split()) > 1} if spaced else set())
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        self.known = pa.concat_arrays([self.known, new])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(encoded), "<u4")])
        return at

    def encode(self, texts: list[str]) -> list[bytes]:
        firsts, rests, tails, spaced = [], [], [], False
        for t in texts:
            cut = None if any(a in t for a in self.added) else body_of(t)
            first, _, rest = cut[0].partition(" ") if cut else (t, "", "")
            spaced = spaced or any(c in rest for c in OTHERS) or "\n\n\n" in rest
            firsts.append(first)
            rests.append(rest or None)
            tails.append(cut[1] if cut else "")
        # the words of all texts as numbers of the distinct ones
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        at = self._places(coded.dictionary, spaced)[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[at]
        ids = self.ids[_spans(self.starts[at], sizes)]
        # the number of ids before each text's words
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        cuts = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
        ends = map(self._all_ids, (firsts, tails))
        return [b"".join([a, ids[s:e].tobytes(), z]) for a, s, e, z in zip(next(ends), cuts[:-1], cuts[1:], next(ends), strict=True)]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(sizes.sum())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it. Arrow knows s3, gs, hdfs and local paths; Hadoop's names of S3 are taken for its own."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


class SequenceFile:
    """Writes one Arrow file and its index."""

    def __init__(self, path: str, dtype: np.dtype, length: int):
        store, at = _store(path)
        store.create_dir(posixpath.dirname(at), recursive=True)
        self.dtype, self.length, self.n, self.rest = dtype, length, 0, np.empty(0, dtype)
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [store.open_output_stream(at), store.open_output_stream(f"{at}.index")]
        self.tokens = pa.ipc.new_file(self.files[0], self.schema)
        self.docs = pa.ipc.new_file(self.files[1], self.docs_schema)

    def add(self, doc_ids: pa.Array, texts_ids: list[bytes]) -> None:
        sizes = np.array([len(x) // 4 for x in texts_ids], np.int64)
        starts = self.n + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.docs_schema))
        self.n += int(sizes.sum())
        self.rest = np.concatenate([self.rest, np.frombuffer(b"".join(texts_ids), "<u4").astype(self.dtype)])
        full = len(self.rest) // (self.length * BATCH) * self.length * BATCH
        for at in range(0, full, self.length * BATCH):
            self._batch(self.rest[at : at + self.length * BATCH])
        self.rest = self.rest[full:]

    def _batch(self, ids: np.ndarray) -> None:
        padded = -len(ids) % self.length
        mask = np.ones(len(ids) + padded, bool)
        mask[len(ids) :] = False
        columns = (pa.array(np.pad(ids, (0, padded))), pa.array(mask))
        self.tokens.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(c, self.length) for c in columns], schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            self._batch(self.rest)
        for x in (self.tokens, self.docs, *self.files):
            x.close()


class SequenceReader:
    """Random access to a file's ids; a local file is mapped, so batches are not copied."""

    def __init__(self, path: str):
        store, at = _store(path)
        local = isinstance(store, fs.LocalFileSystem)
        opened = (lambda p: pa.memory_map(p)) if local else store.open_input_file
        self.tokens, self.docs = pa.ipc.open_file(opened(at)), pa.ipc.open_file(opened(f"{at}.index"))
        self.length = self.tokens.schema.field("tokens").type.list_size
        self.at, self.batch = -1, np.empty(0)

    def ids(self, start: int, n: int) -> np.ndarray:
        size, found = self.length * BATCH, []
        while n:
            k, skip = divmod(start, size)
            if k != self.at:
                self.at, self.batch = k, self.tokens.get_batch(k).column("tokens").flatten().to_numpy(zero_copy_only=True)
            got = self.batch[skip : skip + n]
            found.append(got)
            start, n = start + len(got), n - len(got)
        return found[0] if len(found) == 1 else np.concatenate(found or [self.batch[:0]])


def write(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", length: int = SEQUENCE) -> str:
    """Writes the files and their manifest; returns the folder.

    One range shuffle puts rows in order; rows that share a doc_id are split by the hash of the text.
    Ids are stored in 16 bits where the vocabulary allows it.
    """
    folder = folder or shared_dir(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        dtype = np.dtype(np.uint16 if max(own.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32)
        part, out, n_docs = TaskContext.get().partitionId(), None, 0
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            for some in slices(batch, 1, ROWS_AT_ONCE, BYTES_AT_ONCE):
                out = out or SequenceFile(path, dtype, length)
                out.add(some.column(0), [ids + last for ids in own.encode(some.column(1).to_pylist())])
                n_docs += some.num_rows
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "first_ids": [0], "n_ids": [out.n], "n_docs": [n_docs]})

    rows.select("doc_id", "text").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/written")
    _with_starts(docs.sparkSession, folder).write.parquet(f"{folder}/manifest")
    return folder


def _with_starts(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, one small row per file, with the ids that come before each file."""
    before, rows = 0, []
    for r in spark.read.parquet(f"{folder}/written").orderBy("part").collect():
        rows.append((r["part"], r["path"], before, r["n_ids"], r["n_docs"]))
        before += r["n_ids"]
    return spark.createDataFrame(rows, MANIFEST)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers)."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                reader = SequenceReader(file["path"])
                for k in range(reader.docs.num_record_batches):
                    docs = reader.docs.get_batch(k)
                    starts, sizes = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    ids = [reader.ids(s, m).astype("<u4").tobytes() for s, m in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(starts + file["first_ids"]), docs.column("n_tokens"), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return manifest.repartitionByRange(n, "part").mapInArrow(run, ROWS)
