"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A merge-type model joins the adjacent pair whose piece has the best score, the leftmost first, until no pair is
a piece. A sequence of pieces is the encoding of its text exactly if each two neighbours are the encoding of
their own joined text: no merge crosses a border before another one that the two neighbours would do alone.
So pieces are taken from the left, the longest match first, and a piece stays if it is compatible with the one
before, which re-merging the two shows. Where none is, the search goes back to the next shorter match. As a text
has one encoding only, a position that failed once fails always; a bitfield keeps those. One Aho-Corasick pass
gives each position's longest match; a piece's shorter matches are its own prefixes.

Characters without a piece become their UTF-8 bytes' pieces. Nulls and empty texts give no ids. Texts are encoded
whole, however long. Texts are cut before search only where no piece spans the cut: before white space that follows
something else, and around line feeds.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.llm.common import Memo, slices, unused

#: Fixed values of the model format: the mark for a space, kinds of pieces, fields of the file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
#: Pairs of pieces whose compatibility is remembered.
PAIRS = 400_000
#: Words in a generation of the memo, which a worker keeps from task to task.
WORDS = 300_000
NEVER = float("-inf")
#: An error handler for UTF-8: U+FFFD for one byte, then on with the next.
EACH_BYTE = "fareflow-each-byte"
codecs.register_error(EACH_BYTE, lambda bad: ("\ufffd", bad.start + 1))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value: int | bytes = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class _Stays(dict):
    """By two pieces, whether they are the encoding of their joined text."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        a, b = self.model.text[key >> 32], self.model.text[key & 0xFFFFFFFF]
        self[key] = known = self.model.merged(a + b) == [a, b]
        return known


class PieceModel:
    """A model file's pieces and the search over them."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(fields(file.read()))
        trainer, normalizer = (dict(fields(next((v for k, v in message if k == name), b""))) for name in (TRAINER, NORMALIZER))
        rows = [dict(fields(v)) for k, v in message if k == PIECES]
        kinds = [r.get(3, NORMAL) for r in rows]
        # fixed values: the trainer's kind 2 is merge-type, its field 35 byte fallback, 24 white space as suffix, 44 the unknown surface;
        # the normalizer's field 2 is its table, 3 the dummy prefix, 4 removal of extra white space, 5 its escape
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError(f"{path}: only merge-type models with byte fallback and an identity normalizer are read")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: user-defined and unused pieces are not read")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        texts = [r[1].decode() for r in rows]
        self.ids = {t: i for i, (t, kind) in enumerate(zip(texts, kinds, strict=True)) if kind == NORMAL}
        self.score = {t: struct.unpack("<f", rows[i].get(2, bytes(4)))[0] for t, i in self.ids.items()}
        by_name = {t: i for i, (t, kind) in enumerate(zip(texts, kinds, strict=True)) if kind == BYTE}
        self.byte = [by_name[f"<0x{b:02X}>"] for b in range(256)]
        self.surface = [t.replace(SPACE, " ").encode() if kind == NORMAL else b"" for t, kind in zip(texts, kinds, strict=True)]
        for b, i in enumerate(self.byte):
            self.surface[i] = bytes([b])
        self.control = {i for i, kind in enumerate(kinds) if kind == CONTROL}
        unknown = trainer.get(44, " ⁇ ".encode())
        for i, kind in enumerate(kinds):
            if kind == UNKNOWN:
                self.surface[i] = unknown
        self.spaced = {i for t, i in self.ids.items() if t.startswith(SPACE)}

        if any(c not in self.ids for t in self.ids for c in t):
            raise ValueError(f"{path}: pieces of characters without a piece are not read")
        self.text = texts
        self.size = [len(t) for t in texts]
        # of each piece, the next shorter piece that begins it
        self.shorter = [next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t in texts]
        self.matches = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.matches.add_word(t, (i, len(t) - 1))
        self.matches.make_automaton()
        self.stays = _Stays(self)
        spans = any(SPACE in t.lstrip(SPACE) or "\n" in t for t in self.ids)
        self.cut = re.compile("(?s:.+)" if spans else f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
        self.memo = Memo(self._packed, WORDS)

    def merged(self, text: str) -> list[str]:
        """The model's own rule on a short text: join the pair of best score, the leftmost first."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > NEVER:
            k = scores.index(best)
            parts[k] += parts[k + 1]
            del parts[k + 1], scores[k]
            if k:
                scores[k - 1] = score(parts[k - 1] + parts[k], NEVER)
            if k < len(scores):
                scores[k] = score(parts[k] + parts[k + 1], NEVER)
        return parts

    def search(self, text: str) -> list[int]:
        """The pieces of a text by their ids; a character without a piece stands alone, as a negative number."""
        n, size, shorter, stays = len(text), self.size, self.shorter, self.stays
        longest = [-1] * n
        for last, (piece, before) in self.matches.iter(text):  # of one begin, the longer match comes later
            longest[last - before] = piece
        failed: bytearray | None = None
        found: list[int] = []
        at, last, piece = 0, -1, longest[0] if n else -1
        while at < n:
            if piece < 0:  # no piece has this character, so no merge goes across it
                found.append(-1 - ord(text[at]))
                at, last = at + 1, -1
                piece = longest[at] if at < n else -1
                continue
            end = at + size[piece]
            if (last < 0 or stays[last << 32 | piece]) and not (failed and failed[end >> 3] >> (end & 7) & 1):
                found.append(piece)
                at, last = end, piece
                piece = longest[at] if at < n else -1
                continue
            piece = shorter[piece]
            while piece < 0:  # no match is left here: the piece before goes back to its next shorter match
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = found.pop()
                at -= size[piece]
                last = found[-1] if found else -1
                piece = shorter[piece]
        return found

    def _packed(self, text: str) -> bytes:
        ids = self.search(text)
        if min(ids) < 0:
            ids = [i for x in ids for i in ((x,) if x >= 0 else map(self.byte.__getitem__, chr(-1 - x).encode()))]
        return struct.pack(f"={len(ids)}i", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers of the machine's order."""
        if not text:
            return b""
        return b"".join(map(self.memo.__getitem__, self.cut.findall((self.prefix + text).replace(" ", SPACE))))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: bytes that form no character become U+FFFD, one each; the dummy prefix goes, control pieces are nothing."""
        if self.control.isdisjoint(ids):
            data = b"".join(map(self.surface.__getitem__, ids)).decode(errors=EACH_BYTE)
            return data[1:] if self.prefix and ids and ids[0] in self.spaced else data
        # bytes on both sides of a control piece form no character together
        first = next((i for i in ids if i not in self.control), None)
        runs = (b"".join(map(self.surface.__getitem__, run)) for _, run in itertools.groupby(ids, self.control.__contains__))
        data = "".join(run.decode(errors=EACH_BYTE) for run in runs)
        return data[1:] if self.prefix and first in self.spaced else data


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _ids(parts: Iterable[bytes]) -> pa.ListArray:
    parts = list(parts)
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(
    docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", decoded: str | None = None
) -> DataFrame:
    """The kept columns and `out`, an array of ids, never null.

    With `decoded`, a column of that name follows: the text that the ids decode to. It is made in the same pass, as a
    second Python step would start a second worker, with tables of its own, per task.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    (own,) = unused(kept, "text")
    made = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)]
    made += [T.StructField(decoded, T.StringType(), False)] if decoded is not None else []
    names = [*keep, *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for batch in batches:
            for part in slices(batch, len(keep)):
                packed = [pieces.encode(t) if t else b"" for t in part.column(len(keep)).to_pylist()]
                columns = [_ids(packed)]
                if decoded is not None:
                    columns.append(pa.array([pieces.decode(np.frombuffer(p, np.int32).tolist()) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names)

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(own)).mapInArrow(run, T.StructType([*kept.schema.fields, *made]))


def decode_udf(model_path: str):
    """A column function: arrays of ids to the text they stand for; null gives null."""

    @F.arrow_udf(T.StringType())
    def decoded(ids: pa.Array) -> pa.Array:
        pieces = model(model_path)
        return pa.array([None if x is None else pieces.decode(x) for x in ids.to_pylist()], pa.string())

    return decoded
