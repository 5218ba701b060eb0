"""Spelling variants by a trie of letter counts.

A word is arranged by how often it has each group of letters, group by group: words with the same first counts share
a node. One inserted, deleted or replaced letter gives one count a surplus of one, another a deficit of one, or
either alone. So a depth-first search takes pairs of nodes down together and spends a budget of one surplus and one
deficit; pairs of nodes of few words, and of leaves, are verified word by word.

The trie's upper levels are shuffle keys: a word goes to its own node, and as a visitor to the later nodes that the
budget reaches. The number of these levels follows from the largest node, so that a task holds a bounded share
of the words. A task returns one row per word, not pairs.

Null words are ignored. Words that are given several times count with the sum of their numbers. Ties between forms
go to the word that is first by code points. The empty word is a word like any other.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.llm.common import slices, unused, written

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: The levels of the trie: frequent letters first, one each; all other code points share the last groups.
SINGLE, OTHERS = "etaoinshrdlcumwfgypb", 6
LEVELS = len(SINGLE) + OTHERS
#: Words of a node of the upper levels at most, where MOST_UPPER levels can do that, and the share of all words, if that is less,
#: but for small tables; word pairs that end a descent; word pairs that are verified at once; code points of a word that are
#: compared in blocks; entries of partial counts; code points of a text whose runs are listed at once.
NODE, SHARE, SMALL, MOST_UPPER, FEW, BLOCK, WIDTH, HELD, LISTED = 20_000, 50, 2_000, 12, 16, 1 << 18, 64, 300_000, 1 << 20


def runs(text: str) -> Iterable[str]:
    """The runs of letters of a text; those of a long one aren't held at once."""
    return LETTERS.findall(text) if len(text) < LISTED else map(re.Match.group, LETTERS.finditer(text))


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", one_in: int = 97) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, after slips.

    With h the crc32 of `<doc_id>:<run>`, a run of a document loses its code point h % length where one_in divides h; one_in 0
    turns slips off. A null id is an empty string there. A run that loses its only code point is an empty word.
    """
    schema = T.StructType([T.StructField("word", T.StringType(), False), T.StructField("n", T.LongType(), False)])
    (own,) = unused(docs, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, 1):
                for key, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    # only A-Z have an other case among bytes
                    for word, n in Counter(runs(content.encode().lower().decode()) if content else ()).items():
                        if one_in and (h := zlib.crc32(f"{key}:{word}".encode())) % one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        held[word] += n
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    found = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias(own), F.col(text)).mapInArrow(run, schema)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def group_of(points: np.ndarray) -> np.ndarray:
    """Each code point's level in the trie."""
    table = np.full(128, -1)
    table[[ord(c) for c in SINGLE]] = np.arange(len(SINGLE))
    single = table[np.minimum(points, 127)]
    return np.where((points < 127) & (single >= 0), single, len(SINGLE) + points % OTHERS)


class Words:
    """The words of a task, in the order of their count vectors."""

    def __init__(self, words: list[str], home: np.ndarray):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        rows = np.repeat(np.arange(len(words)), sizes)
        counts = np.bincount(rows * LEVELS + group_of(points), minlength=len(words) * LEVELS).reshape(len(words), LEVELS)
        self.order = np.lexsort(counts.T[::-1])
        self.words, self.sizes, self.counts = [words[k] for k in self.order.tolist()], sizes[self.order], counts[self.order]
        self.homes = np.r_[0, np.cumsum(home[self.order])]
        # the first code points from the left and from the right; longer words are compared alone
        width = min(WIDTH, int(sizes.max(initial=0)))
        kind = np.uint8 if points.max(initial=0) < 256 else np.uint32
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(points)) - begin[rows]
        self.left, self.right = (np.zeros((len(words), width + 1), kind) for _ in range(2))
        back = sizes[rows] - 1 - place
        self.left[rows[place < width], place[place < width]] = points[place < width]
        self.right[rows[back < width], back[back < width]] = points[back < width]
        self.left, self.right = self.left[self.order], self.right[self.order]
        # a mark at the end that differs between words of a pair ends the common part of any two
        self.width = width

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of different words differ by one inserted, deleted or replaced code point."""

        def common(side: np.ndarray) -> np.ndarray:
            differ = side[i] != side[j]
            return np.where(differ.any(1), differ.argmax(1), self.width)

        longer = np.maximum(self.sizes[i], self.sizes[j])
        shorter = np.minimum(self.sizes[i], self.sizes[j])
        parts = np.minimum(common(self.left), shorter) + np.minimum(common(self.right), shorter)
        found = (longer - shorter <= 1) & (parts >= longer - 1)
        for k in np.flatnonzero((longer > self.width) & (longer - shorter <= 1)).tolist():
            found[k] = _near(self.words[i[k]], self.words[j[k]])
        return found

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All near pairs of which one word at least is at home, each once."""
        n = len(self.words)
        # nodes are ranges of rows; both sides of a pair go down together
        a, b = np.array([0]), np.array([0])
        starts = np.array([0])
        surplus, deficit = np.zeros(1, np.int8), np.zeros(1, np.int8)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(LEVELS + 1):
            ends = np.r_[starts[1:], n]
            size, at_home = ends - starts, self.homes[ends] - self.homes[starts]
            alive = at_home[a] + at_home[b] > 0
            a, b, surplus, deficit = a[alive], b[alive], surplus[alive], deficit[alive]
            last = (size[a] * size[b] <= FEW) if level < LEVELS else np.ones(len(a), bool)
            found.extend(self._verified(starts[a[last]], ends[a[last]], starts[b[last]], ends[b[last]]))
            a, b, surplus, deficit = a[~last], b[~last], surplus[~last], deficit[~last]
            if level == LEVELS or not len(a):
                break
            # the children of a node are ranges, too
            count = self.counts[:, level]
            cut = np.r_[True, count[1:] != count[:-1]]
            cut[starts] = True
            below = np.flatnonzero(cut)
            first = np.searchsorted(below, starts)
            kids = np.diff(np.r_[first, len(below)])
            many = kids[a] * kids[b]
            pair = np.repeat(np.arange(len(a)), many)
            k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            x, y = first[a[pair]] + k // kids[b[pair]], first[b[pair]] + k % kids[b[pair]]
            step = count[below[y]] - count[below[x]]
            up, down = surplus[pair] + np.maximum(step, 0), deficit[pair] + np.maximum(-step, 0)
            keep = (x <= y) & (up <= 1) & (down <= 1)
            a, b, surplus, deficit, starts = x[keep], y[keep], up[keep], down[keep], below
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _verified(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near pairs between the words of each two ranges, in blocks of a bounded number of pairs."""
        if not len(a):
            return
        # a range's rows one by one, so that a block has no more than BLOCK pairs and one row's
        rows = a_end - a
        node = np.repeat(np.arange(len(a)), rows)
        i = a[node] + np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
        begin = np.where(a[node] == b[node], i + 1, b[node])
        size = b_end[node] - begin
        upto = np.cumsum(size)
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
            n = size[at:to]
            x = np.repeat(i[at:to], n)
            y = np.repeat(begin[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at_home = (self.homes[x + 1] > self.homes[x]) | (self.homes[y + 1] > self.homes[y])
            # counts bound the distance from below: the sizes alone leave out most pairs of a node of few words
            at_home &= np.abs(self.sizes[x] - self.sizes[y]) <= 1
            x, y = x[at_home], y[at_home]
            yes = self.near(x, y)
            if yes.any():
                yield x[yes], y[yes]
            at = to


def _near(a: str, b: str) -> bool:
    """The same for two words of any length."""
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)
    while low < high:  # the common beginning
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


_PARTIAL = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_near", T.LongType()), T.StructField("form_n", T.LongType()), T.StructField("form", T.StringType())])


def _search(table: pa.Table) -> pa.Table:
    """One upper node: of its words and visitors, how many near words each met here, and the best of them."""
    home = table["home"].to_numpy()
    empty = pa.table([pa.array([], pa.string()), *(pa.array([], pa.int64()) for _ in range(3)), pa.array([], pa.string())], _PARTIAL.names)
    if not home.any():
        return empty
    own = Words(table["word"].to_pylist(), home)
    n = table["n"].to_numpy()[own.order]
    i, j = own.pairs()
    x, y = np.r_[i, j], np.r_[j, i]
    rank = np.empty(len(n), np.int64)
    rank[sorted(range(len(n)), key=own.words.__getitem__)] = np.arange(len(n))
    by = np.lexsort((rank[y], -n[y], x))
    x, y = x[by], y[by]
    first = np.r_[True, x[1:] != x[:-1]] if len(x) else np.empty(0, bool)
    best = np.full(len(n), -1)
    best[x[first]] = y[first]
    met = np.bincount(x, minlength=len(n))
    rows = np.flatnonzero((met > 0) | (np.diff(own.homes) > 0))
    none = best[rows] < 0
    words = pa.array(own.words, pa.string())
    form = pc.if_else(pa.array(none), None, words.take(pa.array(np.maximum(best[rows], 0))))
    return pa.table([words.take(pa.array(rows)), pa.array(n[rows]), pa.array(met[rows]), pa.array(n[best[rows]], mask=none), form], _PARTIAL.names)


def _upper(levels: int) -> list:
    """The first counts of a word, as columns."""
    return [(F.length("word") - F.length(F.translate("word", c, ""))).cast("int") for c in SINGLE[:levels]]


def _later(levels: int) -> list[list[int]]:
    """What a later node's counts differ by within the budget: a surplus first, perhaps a deficit after it."""
    out = []
    for i in range(levels):
        for j in range(i, levels):
            out.append([1 if k == i else -1 if k == j else 0 for k in range(levels)])
    return out


def upper_levels(words: DataFrame, node: int = NODE) -> int:
    """The fewest levels of which no node has more than so many words, nor more than its share, or MOST_UPPER."""
    for levels in range(3, MOST_UPPER, 3):
        most, total = words.groupBy(*_upper(levels)).count().agg(F.max("count"), F.sum("count")).first()
        if most is None or most <= min(node, max(SMALL, total // SHARE)):
            return levels
    return MOST_UPPER


def neighbours(words: DataFrame, node: int = NODE) -> DataFrame:
    """(word, n, n_near, form_n, form) for each (word, n): the number of near words and the best one: of largest n, then first by code points."""
    words = written(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    levels = upper_levels(words, node)
    at = words.select("word", "n", F.array(*_upper(levels)).alias("key"))
    later = F.array(*(F.array(*map(F.lit, step)) for step in _later(levels)))
    reach = F.transform(later, lambda step: F.zip_with("key", step, lambda c, d: c + d))
    visits = at.select("word", "n", F.explode(F.filter(reach, lambda key: F.forall(key, lambda c: c >= 0))).alias("key"), F.lit(False).alias("home"))
    both = at.withColumn("home", F.lit(True)).unionByName(visits).select(F.concat_ws(",", F.col("key").cast("array<string>")).alias("key"), "word", "n", "home")
    found = both.groupBy("key").applyInArrow(_search, _PARTIAL)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n", "n_near", (-F.col("b.less")).alias("form_n"), "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): from each word, forms are followed to the last. Each round doubles the steps."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return at


def variants(words: DataFrame, ratio: int = 2, node: int = NODE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each (word, n): the form is the best near word if its n is `ratio` times the word's at least.

    A ratio of 2 or more makes n grow along forms, so that they end; a smaller one is refused.
    """
    if ratio < 2:
        raise ValueError("forms could lead in circles")
    near = neighbours(words, node)
    right = F.col("form_n") >= ratio * F.col("n")
    near = written(near.withColumns({"form": F.when(right, F.col("form")), "form_n": F.when(right, F.col("form_n"))}), "forms")
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
