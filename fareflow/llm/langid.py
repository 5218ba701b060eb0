"""Language identification by a byte convolutional network.

Bytes are folded to classes (letters without case, one class each for digits, white space and other
ASCII, and each byte from 0x80 up), embedded, and convolved with filters of several widths; each
filter's maximum over a window of fixed length goes through a ReLU to a softmax layer. The network
is trained in numpy on a bounded sample of labelled windows and applied to every window of a text:
windows overlap by the widest filter less one byte, so no position is lost. A text's distribution is
the mean of its windows' distributions, weighted by their letters.

Since the embedding and a filter's first two bytes only depend on a pair of classes, filters are
evaluated as sums of rows of pair tables, which gives the same numbers as the convolution.

Null texts and texts without a letter are `und` with score 0. So is everything when there was no
labelled text to learn from. Ties go to the label that sorts first. Columns of the names of the output
are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.llm.common import unused

#: Bytes in a window.
WINDOW = 256
#: Filters by width. The widest is twice a pair of bytes.
FILTERS = {2: 8, 3: 8, 4: 16}
WIDEST = max(FILTERS)
EMBEDDING = 8
UNKNOWN = "und"


def _classes() -> np.ndarray:
    out = np.full(256, 2, np.int64)
    for b in range(128):
        c = chr(b)
        if c.isalpha():
            out[b] = 4 + ord(c.lower()) - ord("a")
        elif c.isdigit():
            out[b] = 1
        elif c.isspace():
            out[b] = 3
    out[128:] = np.arange(30, 158)
    return out


#: Class 0 pads the end of a text.
CLASSES, N_CLASSES = _classes(), 158


@dataclasses.dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # by byte of the filter: EMBEDDING x all filters; 0 beyond a filter's width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of classes, what it adds to each filter as the first and as the second pair."""
        by_byte = [self.embedding @ w for w in self.filters]
        first = (by_byte[0][:, None] + by_byte[1][None]).reshape(N_CLASSES**2, -1)
        narrow = sum(n for width, n in FILTERS.items() if width <= 2)
        second = (by_byte[2][:, None] + by_byte[3][None]).reshape(N_CLASSES**2, -1)[:, narrow:]
        return np.ascontiguousarray(first, np.float32), np.ascontiguousarray(second, np.float32)


def _pooled(pairs: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Each filter's maximum by window; pairs: position x window."""
    narrow = first.shape[1] - second.shape[1]
    sums = first[pairs[: WINDOW - WIDEST + 1]]
    sums[:, :, narrow:] += second[pairs[2 : WINDOW - WIDEST + 3]]
    return sums.max(axis=0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _as_classes(texts: list[bytes]) -> np.ndarray:
    """Window x byte, from texts of one window at most."""
    out = np.zeros((len(texts), WINDOW), np.int64)
    for i, t in enumerate(texts):
        got = CLASSES[np.frombuffer(t[:WINDOW], np.uint8)]
        out[i, : len(got)] = got
    return out


def train(texts: list[bytes], labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross entropy. The gradient of a maximum goes to the position where it is taken."""
    rng, names = np.random.default_rng(seed), sorted(set(labels))
    widths = np.repeat(list(FILTERS), list(FILTERS.values()))
    n_filters = len(widths)
    covers = np.arange(WIDEST)[:, None] < widths[None]
    weights = {
        "embedding": rng.normal(0, 0.5, (N_CLASSES, EMBEDDING)), "filters": rng.normal(0, 0.3, (WIDEST, EMBEDDING, n_filters)) * covers[:, None],
        "bias": np.zeros(n_filters), "dense": rng.normal(0, 0.2, (n_filters, len(names))), "dense_bias": np.zeros(len(names)),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    x, y = _as_classes(texts), np.searchsorted(names, labels)
    last, step = WINDOW - WIDEST + 1, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xs, n = x[rows], len(rows)
            by_byte = [weights["embedding"] @ weights["filters"][k] for k in range(WIDEST)]
            sums = sum(by_byte[k][xs[:, k : k + last]] for k in range(WIDEST))
            where = sums.argmax(axis=1)
            top = np.take_along_axis(sums, where[:, None], axis=1)[:, 0] + weights["bias"]
            active = np.maximum(top, 0)
            p = _softmax(active @ weights["dense"] + weights["dense_bias"])
            p[np.arange(n), y[rows]] -= 1
            p /= n
            back = (p @ weights["dense"].T) * (top > 0)
            grads = {k: np.zeros_like(v) for k, v in weights.items()}
            grads["dense"], grads["dense_bias"], grads["bias"] = active.T @ p, p.sum(axis=0), back.sum(axis=0)
            for k in range(WIDEST):
                seen = np.take_along_axis(xs, where + k, axis=1)  # window x filter
                one_hot = np.zeros((N_CLASSES, n_filters))
                np.add.at(one_hot, (seen, np.arange(n_filters)[None]), back)
                grads["filters"][k] = (weights["embedding"].T @ one_hot) * covers[k]
                grads["embedding"] += (one_hot * covers[k]) @ weights["filters"][k].T
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(names, weights["embedding"], list(weights["filters"]), weights["bias"], weights["dense"], weights["dense_bias"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", windows_per_label: int = 1500, chars: int = 200) -> Network | None:
    """Trains on `windows_per_label` windows of each label at most; None without labelled text.

    The bound is on the sample only. Distinct texts are taken by their hash, below a share that comes from each
    label's number of distinct texts, so copies count once; one window is cut from each at a place given by the hash.
    The sample, a few hundred bytes a window, goes to the driver; like the network, it grows with the number of labels.
    """
    usable = labelled.select(F.col(text).alias("t"), F.col(lang).alias("y")).where(r"y is not null and t rlike '\\p{L}'").withColumn("h", F.xxhash64("t"))
    sizes = usable.groupBy("y").agg(F.approx_count_distinct("h", 0.02).alias("n"))  # a row for each label, as the network has
    start = F.lit(1) + F.pmod("h", F.greatest(F.length("t") - chars, F.lit(1)).cast("long")).cast("int")
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / (1 << 30)
    # a fifth more than is wanted, as shares are not met exactly; the rank then keeps to the bound
    near = usable.join(F.broadcast(sizes), "y").where(place < 1.2 * windows_per_label / F.col("n")).select("y", "h", F.substring(F.col("t"), start, F.lit(chars)).alias("t"))
    once = near.groupBy("y", "h").agg(F.min("t").alias("t"))
    ranked = once.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("h"), "h"))).where(F.col("k") <= windows_per_label)
    rows = sorted((r["t"].encode(), r["y"]) for r in ranked.collect())
    return train([t for t, _ in rows], [y for _, y in rows]) if rows else None


def _letters(classes: np.ndarray) -> np.ndarray:
    return (classes >= 4).sum(axis=-1)


def _distributions(net: Network, tables: tuple[np.ndarray, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row for each text, which is data[start:end]."""
    stride = WINDOW - WIDEST + 1
    n_windows = np.maximum(1, -(-(ends - starts - WIDEST + 1) // stride))
    owner = np.repeat(np.arange(len(starts)), n_windows)
    at = starts[owner] + stride * (np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows))
    out = np.zeros((len(starts), len(net.labels)))
    for k in range(0, len(owner), 128):
        own, first = owner[k : k + 128], at[k : k + 128]
        where = first[None] + np.arange(WINDOW + 1)[:, None]
        inside = where < ends[own][None]
        classes = np.where(inside, CLASSES[data[np.where(inside, where, 0)]], 0)
        top = np.maximum(_pooled(classes[:-1] * N_CLASSES + classes[1:], *tables) + net.bias, 0)
        p = _softmax(top @ net.dense + net.dense_bias)
        np.add.at(out, own, p * (_letters(classes[:-1].T) + 1e-9)[:, None])
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-30)


def predict(docs: DataFrame, net: Network | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted label and its probability."""
    if net is None:
        return docs.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    kind = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = net.tables()
        for texts in batches:
            texts = texts.fill_null("").cast(pa.large_binary())
            if not len(texts):
                yield pa.array([], pa.struct([("label", pa.string()), ("score", pa.float64())]))
                continue
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            body = texts.buffers()[2]
            data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(1, np.uint8)
            p = _distributions(net, tables, data, offsets[:-1], offsets[1:])
            best = p.argmax(axis=1)
            yield pa.StructArray.from_arrays([pa.array(np.array(net.labels, object)[best], pa.string()), pa.array(p[np.arange(len(p)), best])], ["label", "score"])

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    (name,) = unused(docs, "found")
    found = docs.withColumn(name, predicted(F.col(text)))
    return found.withColumns({
        pred: F.when(has_letter, F.col(name)["label"]).otherwise(UNKNOWN), score: F.when(has_letter, F.col(name)["score"]).otherwise(0.0),
    }).drop(name)
