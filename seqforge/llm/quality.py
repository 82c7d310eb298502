"""Quality classifier: a byte-level convolutional network in numpy (operator 5).

Filters eight bytes wide run over every text at each fourth byte; their largest responses in
overlapping chunks of 256 bytes, which cover the whole text, are the chunk's features; a text's are their
mean, maximum and minimum over its chunks, and a logistic layer makes one probability of them (the minima
tell of chunks that repeat a few words and so have no large responses). Filters are
kept as tables of byte pairs, so that a response is four look-ups and no product.

Filters learn on the driver from chunks of a bounded sample of labelled texts (``sample`` of each label,
those with the least hash of doc_id, as long as they hold ``sample_bytes`` together); the last layer learns
from the same texts, whole, with weights that restore the labels' shares. Everything is seeded. Scoring is
one pass over whole texts, with no shuffle; a task needs about sixty times the bytes of its longest one.
Only bytes of texts enter a score.

Null texts are empty, and an empty text gets the score of a text of padding. Labels that are null, not 0
or 1, or of no document are left out; without labels of both kinds every score is the share of label 1,
or 0.5. Repeated rows have a row each. A null doc_id has the remainder of the empty string. Empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .textbuf import arrow_text
from .tokenizing import slices

WIDTH, STEP, CHUNK, STRIDE, FILTERS = 8, 4, 64, 48, 24  # bytes, bytes, positions, positions
SAMPLE, SAMPLE_BYTES = 1000, 16 << 20  # texts of a label, bytes of all together
EPOCHS, BATCH, CHUNKS_A_TEXT, RATE, DECAY = 14, 256, 8, 0.02, 1e-4
THRESHOLD = 0.3


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _padded(texts: list[bytes]):
    """One buffer with WIDTH zero bytes after each text; place and number of its filter positions."""
    data = np.frombuffer(b"".join(t + bytes(WIDTH) for t in texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    return data, np.cumsum(size + WIDTH) - size - WIDTH, np.maximum(1, -(-size // STEP))


class Network:
    """filters: WIDTH x 256 x FILTERS, bias: FILTERS; head: the weights of means, maxima and minima, offset."""

    def __init__(self, filters, bias, head, offset):
        self.bias, self.head, self.offset = bias.astype(np.float32), head, offset
        f = filters.astype(np.float32)
        self.pairs = [(f[2 * j][:, None, :] + f[2 * j + 1][None, :, :]).reshape(65536, -1) for j in range(WIDTH // 2)]

    def features(self, texts: list[bytes]) -> np.ndarray:
        data, start, count = _padded(texts)
        pair = data[:-1].astype(np.int32) * 256 + data[1:]
        first = np.cumsum(count) - count
        total = int(count.sum())
        at = np.repeat(start - first * STEP, count) + np.arange(total) * STEP
        y = self.pairs[0][pair[at]]
        for j in range(1, WIDTH // 2):
            y += self.pairs[j][pair[at + 2 * j]]
        y = np.maximum(y + self.bias, 0, out=y)
        y = np.concatenate((y, np.zeros((1, y.shape[1]), np.float32)))
        chunks = np.maximum(1, -(-(count - CHUNK + STRIDE) // STRIDE))
        chunk_first = np.cumsum(chunks) - chunks
        begin = np.repeat(first - chunk_first * STRIDE, chunks) + np.arange(int(chunks.sum())) * STRIDE
        end = np.minimum(begin + CHUNK, np.repeat(first + count, chunks))
        pooled = np.maximum.reduceat(y, np.stack([begin, end], 1).ravel())[::2]
        mean = np.add.reduceat(pooled, chunk_first) / chunks[:, None]
        return np.concatenate((mean, np.maximum.reduceat(pooled, chunk_first), np.minimum.reduceat(pooled, chunk_first)), 1).astype(np.float64)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.features(texts) @ self.head + self.offset)


def _adam(params, grads, state, t, rate):
    for p, g, (m, v) in zip(params, grads, state):
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _learn_filters(texts, labels, rng):
    """Filters and bias, from random chunks that bear their text's label."""
    span = CHUNK * STEP
    filters, bias = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), np.zeros(FILTERS)
    top, offset = rng.normal(0, 0.5, FILTERS), np.zeros(1)
    params = [filters, bias, top, offset]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t = 0
    for _ in range(EPOCHS):
        rows, ys = [], []
        for x, y in zip(texts, labels):
            for _ in range(min(CHUNKS_A_TEXT, max(1, -(-len(x) // span)))):
                a = int(rng.integers(0, max(1, len(x) - span + 1)))
                size = span if rng.random() < 0.5 else int(rng.integers(16, span))
                rows.append((x[a : a + size] + bytes(span + WIDTH))[: span + WIDTH])
                ys.append(y)
        data = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), span + WIDTH)
        order, ys = rng.permutation(len(rows)), np.array(ys, np.float64)
        for lo in range(0, len(rows), BATCH):
            own = order[lo : lo + BATCH]
            x, target = data[own], ys[own]
            y = bias + sum(filters[j][x[:, j : j + span : STEP]] for j in range(WIDTH))
            best = y.argmax(1)
            pooled = np.maximum(np.take_along_axis(y, best[:, None, :], 1)[:, 0], 0)
            error = (_sigmoid(pooled @ top + offset) - target) / len(own)
            back = error[:, None] * top * (pooled > 0)
            grads = [DECAY * filters, back.sum(0), pooled.T @ error + DECAY * top, error.sum(keepdims=True)]
            column = np.broadcast_to(np.arange(FILTERS), best.shape)
            for j in range(WIDTH):
                np.add.at(grads[0][j], (np.take_along_axis(x, best * STEP + j, 1), column), back)
            t += 1
            _adam(params, grads, state, t, RATE)
    return filters, bias


def _learn_head(features, labels, weights, ridge=1e-3):
    """Weighted logistic regression by Newton's method, on standardised features."""
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = np.column_stack(((features - mean) / scale, np.ones(len(labels))))
    w, keep = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-9)
    weights = weights / weights.sum()
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (weights * p * (1 - p) + 1e-9)) @ x + np.diag(keep), x.T @ (weights * (p - labels)) + keep * w)
        w -= step * min(1, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] / scale) @ mean)


def _excerpts(texts: list[bytes], seed: int) -> list[bytes]:
    """A short piece of each text, from its middle, so that the last layer knows short texts as well."""
    rng, out = np.random.default_rng(seed + 1), []
    for x in texts:
        size = int(2 ** rng.uniform(4, 9))
        a = max(0, (len(x) - size) // 2)
        out.append(x[a : a + size])
    return out


def _batches(texts: list[bytes], limit: int = 1 << 18):
    """The texts in order, about ``limit`` bytes at a time; a longer text alone."""
    own, size = [], 0
    for x in texts:
        if own and size + len(x) > limit:
            yield own
            own, size = [], 0
        own.append(x)
        size += len(x)
    if own:
        yield own


def train(texts: list[bytes], labels: list[int], share: float, seed: int = 5) -> Network | None:
    """A network from labelled texts; share: of label 1 among all labels. None without both labels."""
    y = np.array(labels, np.float64)
    if not 0 < y.sum() < len(y):
        return None
    filters, bias = _learn_filters(texts, labels, np.random.default_rng(seed))
    net = Network(filters, bias, None, 0.0)
    texts, y = texts + _excerpts(texts, seed), np.append(y, y)
    features = np.concatenate([net.features(own) for own in _batches(texts)])
    net.head, net.offset = _learn_head(features, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    return net


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(5)) == 0


def _affordable(rows, sample_bytes: int):
    """Of (order, doc_id, quality, size) rows those that fit the bytes, half for each label, in order."""
    left = {0: sample_bytes // 2, 1: sample_bytes // 2}
    for _, doc, quality, size in sorted(rows):
        if size <= left[quality]:
            left[quality] -= size
            yield doc, quality


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[Network | None, float]:
    """(network, share of label 1), from labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return None, share
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    some = F.broadcast(picked[0].union(picked[1]))  # twice ``sample`` rows of two numbers at most
    own = texts(docs)
    sizes = own.join(some, "doc_id").select(F.xxhash64("doc_id").alias("turn"), "doc_id", "quality", F.octet_length("text").alias("size"))
    sizes = sizes.orderBy("turn", "doc_id", "quality", "size").limit(2 * sample).collect()
    chosen = docs.sparkSession.createDataFrame(list(_affordable(sizes, sample_bytes)), "doc_id long, quality int").distinct()
    rows = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").orderBy("doc_id", "quality", "text").limit(2 * sample).collect()
    return train([r.text.encode() for r in rows], [r.quality for r in rows], share), share


def score(docs: DataFrame, network: Network | None, share: float = 0.5) -> DataFrame:
    """docs' doc_id and the score of each text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = arrow_text(part["text"])
                raw = data.tobytes()
                own = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                found = network.scores(own) if network else np.full(len(own), share)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in part.schema.names if c != "text"), pa.array(found)], names=[*(c for c in part.schema.names if c != "text"), "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, network: Network | None, share: float = 0.5, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""

    at = f"c{docs.columns.index('text')}"

    def run(batches):
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                data, offsets = arrow_text(part[at])
                raw = data.tobytes()
                own = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield part.filter(pa.array(network.scores(own) >= threshold if network else np.full(len(own), share >= threshold)))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names of any kind do no harm
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network, share = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, network, share).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
