"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters slide over overlapping chunks that cover the whole text. Each filter's largest
response in a chunk is kept; a text's features are their means over its chunks, so that a long text does not score high
for its length alone. A logistic unit combines them into one probability. Training follows the chain rule by hand:
max-pooling passes the gradient to one position per filter and chunk.

Bounds: the network is fitted on at most ``TRAIN_ROWS`` labelled rows in hash order and on at most ``TRAIN_CHUNKS``
chunks of each, spread over the text; both are parameters. Scoring reads every chunk of every text.

Stated cases: a null or empty text is one chunk of padding and gets that chunk's score; rows without an id or with a
null label teach nothing; with one class missing every score is the share of the class seen; repeated rows score
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from probatum.llm.common import col, slices, typed

TRAIN_ROWS = 4_000
TRAIN_CHUNKS = 4
CHUNK, STEP = 512, 448  # bytes of a chunk, and from one chunk to the next
EMBED, WIDTH, FILTERS = 6, 5, 16
EPOCHS, BATCH, RATE = 12, 64, 3e-3


def chunk_rows(text: str | None) -> np.ndarray:
    """The chunks of a text as rows of CHUNK symbols: bytes, and 256 behind the end."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int16)
    n = max(1, -(-max(len(data) - (CHUNK - STEP), 1) // STEP))
    padded = np.full((n - 1) * STEP + CHUNK, 256, np.int16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.filters = r.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(FILTERS, np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.out, self.bias]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, position, WIDTH * EMBED)"""
        e = self.embed[chunks].reshape(len(chunks), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, ::EMBED]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in every chunk, and where it is."""
        w = self.windows(chunks)
        r = np.ascontiguousarray(w).reshape(-1, WIDTH * EMBED) @ self.filters
        r = r.reshape(len(chunks), -1, FILTERS)
        at = r.argmax(axis=1)
        return np.maximum(np.take_along_axis(r, at[:, None], axis=1)[:, 0] + self.shift, 0), at

    def features(self, chunks: np.ndarray) -> np.ndarray:
        """Largest responses only, some chunks at a time."""
        out = []
        for k in range(0, len(chunks), 64):
            part = chunks[k : k + 64]
            r = np.ascontiguousarray(self.windows(part)).reshape(-1, WIDTH * EMBED) @ self.filters
            out.append(r.reshape(len(part), -1, FILTERS).max(axis=1))
        return np.maximum(np.concatenate(out) + self.shift, 0)

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss; owner is the text of each chunk."""
        pooled, at = self.pooled(chunks)
        share = (1 / np.bincount(owner, minlength=len(y))).astype(np.float32)[owner]
        feats = np.zeros((len(y), FILTERS), np.float32)
        np.add.at(feats, owner, pooled * share[:, None])
        p = 1 / (1 + np.exp(-np.clip(feats @ self.out + self.bias[0], -30, 30)))
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        d_pooled = d[owner, None] * self.out[None, :] * share[:, None] * (pooled > 0)
        places = at[:, :, None] + np.arange(WIDTH)  # (chunk, filter, WIDTH)
        symbols = np.take_along_axis(chunks[:, None, :], places.reshape(len(chunks), 1, -1), axis=2).reshape(places.shape)
        seen = self.embed[symbols].reshape(len(chunks), FILTERS, WIDTH * EMBED)
        d_filters = np.einsum("cf,cfw->wf", d_pooled, seen)
        d_seen = d_pooled[:, :, None] * self.filters.T[None]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, symbols.reshape(-1), d_seen.reshape(-1, EMBED))
        return [d_embed, d_filters, d_pooled.sum(axis=0), feats.T @ d + 1e-4 * self.out, d.sum(keepdims=True)]

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 5) -> Network:
        """Adam; both classes weigh the same in total at first, then the constant is set for the true shares."""
        r = np.random.default_rng(seed)
        chunks = []
        for t in texts:
            rows = chunk_rows(t)
            chunks.append(rows[np.unique(np.linspace(0, len(rows) - 1, TRAIN_CHUNKS).round().astype(int))])
        y = y.astype(np.float32)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        first, second = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        step = 0
        epochs = max(EPOCHS, -(-600 * BATCH // max(len(texts), 1)))
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                owner = np.repeat(np.arange(len(pick)), [len(chunks[i]) for i in pick])
                found = self.gradients(np.concatenate([chunks[i] for i in pick]), owner, y[pick], weight[pick])
                step += 1
                for p, g, a, b in zip(self.parameters(), found, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows = [chunk_rows(t) for t in texts]
        counts = np.array([len(x) for x in rows])
        sums = np.add.reduceat(self.features(np.concatenate(rows)), np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        z = (sums / counts[:, None]) @ self.out + self.bias[0]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))


def quality_scores(documents: DataFrame, labels: DataFrame, teach: Column, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: doc_id), ``score`` and ``predicted`` of all rows.

    ``labels`` has doc_id and quality; ``teach`` is a condition on doc_id that says which labelled rows may be learnt from.
    """
    docs = typed(documents, doc_id="bigint", text="string")
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & teach)
             # ids with contradicting labels teach nothing
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other"))
    # the ids are drawn before any text is touched: every label of the rarer class first, up to half of the rows
    turn = F.xxhash64("doc_id")
    chosen = [known.filter(F.col("label") == k).orderBy(turn, "doc_id").limit(TRAIN_ROWS // 2) for k in (0, 1)]
    # of several texts under one id the smallest teaches
    sample = docs.join(chosen[0].unionByName(chosen[1]), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    spots = TRAIN_CHUNKS * CHUNK  # characters: enough for the chunks that training looks at
    seen = sample.select("doc_id", "label", F.when(F.length("text") <= 4 * spots, F.col("text")).otherwise(
        F.concat(*[F.expr(f"substring(text, cast(1 + (length(text) - {CHUNK}) * {k / (TRAIN_CHUNKS - 1)} as int), {CHUNK})") for k in range(TRAIN_CHUNKS)])).alias("text")).toPandas().sort_values("doc_id")
    y = seen["label"].to_numpy(float)
    share, n = known.agg(F.coalesce(F.avg("label"), F.lit(0.5)), F.count(F.lit(1))).first()
    net = Network()
    odds = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if len(set(y)) == 2:
        net.fit([t or "" for t in seen["text"]], y)
        # balanced in training; the true odds enter by the constant
        net.bias = net.bias + np.float32(np.clip(odds, -3, 3) * 0.5)
    else:
        net.out[:], net.bias = 0, np.array([odds], np.float32)
    model = documents.sparkSession.sparkContext.broadcast(net)
    names = keep or ["doc_id"]
    source = documents.select(*map(col, names), F.col("text").cast("string").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            scores = model.value.score(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    scored = source.mapInArrow(work, StructType([*source.schema.fields[:-1], StructField("score", DoubleType())]))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
