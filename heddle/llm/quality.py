"""Quality classifier: a byte-level convolutional network in numpy.

A filter spans `WIDTH` bytes; what it gives for a byte at each of its places is a learned table, which is a convolution over
one-hot bytes. Responses are max-pooled over overlapping chunks that cover the whole document, a small dense layer turns
a chunk's maxima into one number, and the mean and the lowest of these numbers give one probability. The score of a document
depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import bytes_of, column, pick, small_batches, steps

WIDTH = 4
FILTERS = 16
HIDDEN = 16
#: Bytes of half a chunk; chunks overlap by one half.
HALF = 128
#: Bounds of the training sample, the only part of the data that reaches the driver: rows of each class, and chunks of each text.
TRAIN_ROWS = 2000
TRAIN_CHUNKS = 12
#: The response where there is no byte.
NOTHING = -1e9
#: Documents at or above are kept.
THRESHOLD = 0.3


class Network:
    """Filter tables (place, byte, filter), dense layer, and the weights of a document's mean, lowest and bias."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.weights = {
            "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "dense": rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
            "dense_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
            "end": np.array([1, 1, 0], np.float32),
        }

    def responses(self, raw: np.ndarray) -> np.ndarray:
        """Of every filter at every byte but the last WIDTH."""
        table = self.weights["table"]
        if not hasattr(self, "_pairs"):
            self._pairs = [(table[k][:, None, :] + table[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        wide = raw.astype(np.int32)
        pair = wide[:-1] * 256 + wide[1:]
        n = len(raw) - WIDTH
        out = self._pairs[0][pair[:n]]
        for k in range(2, WIDTH, 2):
            out += self._pairs[k // 2][pair[k : k + n]]
        return out

    def halves(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over each half chunk of each text, and where each text's begin (a text has one at least).
        Behind a text a filter reads zero bytes. A text without bytes has no response."""
        raw, first, sizes = _parted(raw, first)
        counts = np.maximum(1, -(-sizes // HALF))
        at = np.concatenate([[0], np.cumsum(counts)])
        begin = np.repeat(first, counts) + HALF * (np.arange(at[-1]) - np.repeat(at[:-1], counts))
        out = np.full((at[-1], FILTERS), NOTHING, np.float32)
        full = np.repeat(sizes > 0, counts)
        step = 4096  # half chunks at once, so that responses stay small
        places = np.flatnonzero(full)
        ends = np.minimum(begin + HALF, np.repeat(first + sizes, counts))
        for i in range(0, len(places), step):
            some = places[i : i + step]
            low, high = begin[some[0]], ends[some[-1]]
            edges = np.column_stack([begin[some], ends[some]]).ravel() - low  # between a text and the next lie zeros
            out[some] = np.maximum.reduceat(self.responses(raw[low : high + WIDTH]), edges[:-1], axis=0)[::2]
        return out, at

    def chunks(self, halves: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over chunks: two neighbouring halves, or the only one; and where each text's begin."""
        counts = np.diff(at)
        keep = np.ones(len(halves), bool)
        keep[(at[1:] - 1)[counts > 1]] = False  # a last half has no right neighbour
        left = np.flatnonzero(keep)
        alone = np.repeat(counts == 1, counts)[left]
        right = np.where(alone, left, left + 1)
        return np.maximum(halves[left], halves[right]), np.concatenate([[0], np.cumsum(np.maximum(1, counts - 1))])

    def logits(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.weights
        active = np.maximum(pooled + w["bias"], 0)
        hidden = np.maximum(active @ w["dense"] + w["dense_bias"], 0)
        return active, hidden, hidden @ w["out"]

    def scores(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each text."""
        if len(first) < 2:
            return np.zeros(0)
        pooled, at = self.chunks(*self.halves(raw, first))
        logit = self.logits(pooled)[2].astype(np.float64)
        mean = np.add.reduceat(logit, at[:-1]) / np.diff(at)
        low = np.minimum.reduceat(logit, at[:-1])
        end = self.weights["end"].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(end[0] * mean + end[1] * low + end[2], -30, 30)))


def _parted(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with WIDTH zero bytes behind each: bytes, where each begins, and their sizes."""
    sizes = np.diff(first)
    begin = first[:-1] + WIDTH * np.arange(len(sizes))
    out = np.zeros(len(raw) + WIDTH * len(sizes), np.uint8)
    for a, b, n in zip(begin.tolist(), first[:-1].tolist(), sizes.tolist(), strict=True):
        out[a : a + n] = raw[b : b + n]
    return out, begin, sizes


def train(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by Adam on the logistic loss, both classes weighing the same. Of a long text, `TRAIN_CHUNKS` chunks at even
    distances are used. Without both classes the network says how often 1 was seen (a half when nothing was)."""
    net = Network(seed)
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.weights["out"][:] = 0
        rate_of_one = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        net.weights["end"] = np.array([0, 0, np.log(rate_of_one / (1 - rate_of_one))], np.float32)
        return net
    rng = np.random.default_rng(seed)
    samples = [_windows(t) for t in texts]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step = 0
    for _ in range(epochs or max(12, 20_000 // len(texts))):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            windows = np.concatenate([samples[j][0] for j in some])
            lengths = np.concatenate([samples[j][1] for j in some])
            at = np.concatenate([[0], np.cumsum([len(samples[j][1]) for j in some])])
            grads = _gradients(net, windows, lengths, at, labels[some], weight[some])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                net.weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.__dict__.pop("_pairs", None)
    return net


def _windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of a text for training, each with the bytes a filter reads past its end, and how many places each has."""
    raw = np.frombuffer(text, np.uint8)
    counts = max(1, -(-len(raw) // HALF) - 1)
    chosen = np.unique(np.linspace(0, counts - 1, min(counts, TRAIN_CHUNKS)).astype(int))
    out = np.zeros((len(chosen), 2 * HALF + WIDTH), np.uint8)
    for row, k in zip(out, chosen, strict=True):
        part = raw[k * HALF : k * HALF + 2 * HALF + WIDTH]
        row[: len(part)] = part
    return out, np.minimum(2 * HALF, len(raw) - chosen * HALF)


def _gradients(net: Network, windows: np.ndarray, lengths: np.ndarray, at: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict:
    w = net.weights
    places = 2 * HALF
    response = np.zeros((len(windows), places, FILTERS), np.float32)
    for k in range(WIDTH):
        response += w["table"][k][windows[:, k : k + places]]
    response[np.arange(places) >= lengths[:, None]] = NOTHING
    best = response.argmax(1)
    pooled = np.take_along_axis(response, best[:, None, :], 1)[:, 0]
    active, hidden, logit = net.logits(pooled)
    sizes = np.diff(at)
    mean = np.add.reduceat(logit, at[:-1]) / sizes
    low = np.minimum.reduceat(logit, at[:-1])
    end = w["end"]
    p = 1 / (1 + np.exp(-np.clip(end[0] * mean + end[1] * low + end[2], -30, 30)))
    d = ((p - labels) * weight / len(labels)).astype(np.float32)
    grads = {"end": np.array([(d * mean).sum(), (d * low).sum(), d.sum()], np.float32)}
    is_low = logit == np.repeat(low, sizes)
    ties = np.add.reduceat(is_low.astype(np.float32), at[:-1])
    dl = np.repeat(d * end[0] / sizes, sizes) + is_low * np.repeat(d * end[1] / ties, sizes)
    grads["out"] = hidden.T @ dl
    dh = dl[:, None] * w["out"] * (hidden > 0)
    grads["dense"], grads["dense_bias"] = active.T @ dh, dh.sum(0)
    da = (dh @ w["dense"].T) * (active > 0)
    grads["bias"] = da.sum(0)
    table = np.zeros_like(w["table"])
    rows = np.arange(len(windows))[:, None]
    filters = np.broadcast_to(np.arange(FILTERS), best.shape)
    for k in range(WIDTH):
        np.add.at(table[k], (windows[rows, best + k], filters), da)
    grads["table"] = table
    return grads


def held_out(doc_id):
    """Whether a document's label is kept from training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[bytes], np.ndarray]:
    """At most `rows` labelled texts of each class that are not held out, chosen by a hash of their id.

    Only ids are compared over all labels; the texts of the chosen ones alone reach the driver, each cut to the chunks that
    training would use anyway. Null ids, labels other than 0 and 1 and null texts are left out; an id with two
    different labels is left out too.
    """
    given = pick(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = given.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    chosen = [one.filter(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])
    texts = pick(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.col("text").isNotNull())
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, first = bytes_of(batch.column("text"))
            parts = [_sampled(raw[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "part": pa.array(parts, pa.binary())})

    kind = texts.schema["doc_id"].dataType.simpleString()
    sample = texts.select("doc_id", "quality", "text").mapInArrow(cut, f"doc_id {kind}, quality int, part binary")
    # repeated rows must not pass the bound
    found = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "part").limit(2 * rows).collect()
    return [bytes(r.part) for r in found], np.array([r.quality for r in found], np.float32)


def _sampled(text: bytes) -> bytes:
    """A text cut down to evenly spaced stretches if it has more than training uses."""
    if len(text) <= 2 * HALF * TRAIN_CHUNKS:
        return text
    starts = np.linspace(0, len(text) - 2 * HALF, TRAIN_CHUNKS).astype(int)
    return b"".join(text[a : a + 2 * HALF] for a in starts.tolist())


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from `THRESHOLD` on).

    The whole text counts. A null text scores as an empty one; equal texts score alike; repeated rows each get their score. A
    null id is not held out. There is no shuffle; what each task gets besides its rows is the network, of fixed size.
    """
    rows = pick(docs, "doc_id", "text").withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    small_batches(docs.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    weights = net.weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.weights = weights
        for table in steps(batches):
            found = own.scores(*bytes_of(column(table, "text")))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": column(table, "doc_id"),
                    "held_out": column(table, "held_out"),
                    "score": found,
                    "predicted": (found >= THRESHOLD).astype(np.int32),
                }
            )

    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of docs(text, ...) whose whole text scores at least `THRESHOLD`, with all their columns. A null text scores as an
    empty one."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    small_batches(docs.sparkSession)
    weights = net.weights

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.weights = weights
        for table in steps(batches, text):
            good = own.scores(*bytes_of(column(table, text))) >= THRESHOLD
            yield from table.filter(pa.array(good)).to_batches()

    return plain.mapInArrow(keep, plain.schema).toDF(*names)
