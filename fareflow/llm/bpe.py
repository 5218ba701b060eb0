"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is a sequence of pre-token matches; each match is encoded alone. A match is cut in halves
down to short leaves, and two encoded neighbours are joined by re-encoding a window around their
border. The window grows until the tokens outside it provably stay: a token sequence is the BPE
encoding of its bytes if each two adjacent tokens encode their own joined bytes, so only the pairs
at the two edges of the window have to be checked. Decoding is the other half of the same homomorphism: halves of the
ids are decoded alone and their bytes concatenated, up the tree.

Nulls and empty texts give no ids. Texts are encoded whole, however long. A match is one task's work: a run of one
letter, whose windows must grow wide, takes a second for each 45,000 letters or so, in linear time.
"""

from __future__ import annotations

import base64
import functools
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.llm.common import Memo, slices, unused, words_of

#: Fixed value: Unicode White_Space, what \s is for the pattern's own library.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEAF = 16
#: Ids in a leaf of the tree of decoding.
DECODED = 1024
#: Pairs of tokens that are remembered.
PAIRS = 400_000
NEVER = 1 << 62


def compiled(pattern: str):
    """The pattern with \\s spelled out, so that it does not depend on the regex library's tables."""
    spelled = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(spelled)


class _Joined(dict):
    """By two tokens, the rank of their joined bytes; NEVER where these are no token."""

    def __init__(self, ranks: dict[bytes, int], of: dict[int, bytes]):
        super().__init__()
        self.ranks, self.of = ranks, of

    def __missing__(self, key: int) -> int:
        rank = self[key] = self.ranks.get(self.of[key >> 32] + self.of[key & 0xFFFFFFFF], NEVER)
        return rank


class PairEncoder:
    """BPE over bytes by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.of = ranks, {v: k for k, v in ranks.items()}
        self.joined, self.single = _Joined(ranks, self.of), [ranks.get(bytes([c]), -1) for c in range(256)]
        self._stays: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by the plain rule: merge the pair of least rank, the leftmost first."""
        n = len(data)
        if n > 4 * LEAF:
            return self._merged_long(data)
        joined = self.joined
        if len(joined) > PAIRS:
            joined.clear()
        ids = [self.single[c] for c in data]
        # of each token joined with the next; tokens are ranks
        ranks = [joined[a << 32 | b] for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            ids[i] = least
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = joined[ids[i - 1] << 32 | least]
            if i < len(ranks):
                ranks[i] = joined[least << 32 | ids[i + 1]]
        return ids

    def _merged_long(self, data: bytes) -> list[int]:
        """The same rule with a heap, for windows that grew long."""
        n, get = len(data), self.ranks.get
        end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and (r := get(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or (j := nxt[i]) < 0 or end[j] != stop:
                continue
            end[i], nxt[i], end[j] = stop, nxt[j], -1
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i >= 0:
            out.append(self.ranks[data[i : end[i]]])
            i = nxt[i]
        return out

    def forget(self) -> None:
        self._stays.clear()
        self.joined.clear()

    def stays(self, a: int, b: int) -> bool:
        """True if these two tokens are the encoding of their joined bytes."""
        known = self._stays.get(key := a << 32 | b)
        if known is None:
            if len(self._stays) > PAIRS:
                self._stays.clear()
            known = self._stays[key] = self.merged(self.of[a] + self.of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: the encoding of both halves' bytes from their encodings."""
        if not left or not right:
            return left or right
        i, j, wider_l, wider_r = len(left) - 1, 1, 1, 1
        while True:
            window = self.merged(b"".join(map(self.of.__getitem__, left[i:] + right[:j])))
            keeps_l = i == 0 or self.stays(left[i - 1], window[0])
            keeps_r = j == len(right) or self.stays(window[-1], right[j])
            if keeps_l and keeps_r:
                return left[:i] + window + right[j:]
            if not keeps_l:
                i, wider_l = max(0, i - wider_l), 2 * wider_l
            if not keeps_r:
                j, wider_r = min(len(right), j + wider_r), 2 * wider_r

    def reduced(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        mid = len(data) // 2
        return self.join(self.reduced(data[:mid]), self.reduced(data[mid:]))

    def encode(self, data: bytes) -> list[int]:
        """One match's ids. A match that is itself a token is that token."""
        known = self.ranks.get(data)
        return [known] if known is not None else self.reduced(data)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, concatenated up a tree of halves."""
        if len(ids) <= DECODED:
            return b"".join(map(self.of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class TextEncoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, pairs: PairEncoder, pattern: str):
        self.pairs, self.pattern = pairs, compiled(pattern)
        self.by_match = Memo(lambda m: struct.pack(f"<{len(ids := self.pairs.encode(m.encode()))}I", *ids))
        self.by_word = Memo(lambda w: self._matches(w if w[:1] == "\n" else f" {w}"))

    def forget(self) -> None:
        self.by_match.forget()
        self.by_word.forget()
        self.pairs.forget()

    def decode(self, ids: bytes) -> bytes:
        return self.pairs.decode(np.frombuffer(ids, "<u4").tolist())

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self.by_match.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Words, with the space or line feed before them, are looked up; the pattern must begin a match there."""
        cut = words_of(text)
        if cut is None:
            return self._matches(text)
        first, rest, tail = cut
        return b"".join([self._matches(first), *map(self.by_word.__getitem__, rest), self._matches(tail)])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(PairEncoder(read_ranks(path)), pattern)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", decoded: str | None = None
) -> DataFrame:
    """The kept columns and `out`, binary: the ids as little-endian unsigned 32-bit integers.

    With `decoded`, a column of that name follows: the bytes that the ids decode to. It is made in the
    same pass, as a second Python step would start a second worker, with tables of its own, per task.
    """
    kept, made = docs.select(*(F.col(f"`{c}`") for c in keep)), [out] if decoded is None else [out, decoded]
    (hidden,) = unused(kept, "text")
    schema = T.StructType([*kept.schema.fields, *(T.StructField(name, T.BinaryType(), False) for name in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        try:
            for batch in batches:
                for part in slices(batch, len(keep)):
                    columns = [[own.encode(t) if t else b"" for t in part.column(len(keep)).to_pylist()]]
                    if decoded is not None:
                        columns.append([own.decode(ids) for ids in columns[0]])
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c, pa.binary()) for c in columns)], [*keep, *made])
        finally:
            own.forget()  # a worker may stay idle for long
            pa.default_memory_pool().release_unused()

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(hidden)).mapInArrow(run, schema)


def decode_udf(ranks_path: str, pattern: str):
    """A column function: binary ids to the bytes they stand for."""

    @F.arrow_udf(T.BinaryType())
    def decoded(ids: pa.Array) -> pa.Array:
        own = encoder(ranks_path, pattern)
        return pa.array([None if x is None else own.decode(x) for x in ids.to_pylist()], pa.binary())

    return decoded
