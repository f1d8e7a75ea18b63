"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. FILTERS learned filters of
WIDTH bytes run over each chunk and are max-pooled; mean, maximum and minimum of the pooled values
over the chunks go through one hidden layer to one probability, which Platt scaling calibrates to
the share of good documents. It is trained on the driver on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.sampling import fold, order_of, sample_by_class, within_bytes

FILTERS, WIDTH, STEP, HIDDEN = 16, 6, 2, 16
#: Chunks of LENGTH bytes begin every ADVANCE bytes.
LENGTH, ADVANCE = 256, 192
#: Chunks that go through the filters at once.
BLOCK = 256


def chunks_of(text: bytes) -> np.ndarray:
    """The chunks that cover a text, one a row; the last is filled up with zero bytes."""
    n = max(1, -(-max(len(text) - (LENGTH - ADVANCE), 1) // ADVANCE))
    data = np.zeros(ADVANCE * (n - 1) + LENGTH, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(data, LENGTH)[::ADVANCE]


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    shift: np.ndarray
    hidden: np.ndarray  # 3 FILTERS x HIDDEN
    hidden_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def convolved(self, chunks: np.ndarray) -> np.ndarray:
        """chunks x places x FILTERS."""
        places = (LENGTH - WIDTH) // STEP + 1
        z = self.filters[0].take(chunks[:, : places * STEP : STEP], axis=0)
        for k in range(1, WIDTH):
            z += self.filters[k].take(chunks[:, k : k + places * STEP : STEP], axis=0)
        return z

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        parts = [self.convolved(chunks[at : at + BLOCK]).max(axis=1) for at in range(0, len(chunks), BLOCK)]
        return np.maximum(np.concatenate(parts) + self.shift, 0)

    def logits(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """starts: the first row of each document's chunks."""
        sizes = np.diff(np.append(starts, len(pooled)))[:, None]
        x = np.concatenate([np.add.reduceat(pooled, starts) / sizes, np.maximum.reduceat(pooled, starts), np.minimum.reduceat(pooled, starts)], axis=1)
        return np.tanh(x @ self.hidden + self.hidden_shift) @ self.out + self.out_shift[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities; texts go through in groups of bounded size, a longer text alone."""
        out, group, size = [], [], 0
        for text in [*texts, None]:
            if text is None or group and size + len(text) > LENGTH * BLOCK:
                out.append(self._group(group)) if group else None
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text)
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))

    def _group(self, texts: list[bytes]) -> np.ndarray:
        each = [chunks_of(t) for t in texts]
        starts = np.cumsum([0, *map(len, each)])[:-1]
        if len(each) == 1:  # a view; blocks of it are copied one at a time
            return self.logits(self.pooled(each[0]), starts)
        return self.logits(self.pooled(np.concatenate(each)), starts)


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 12, most_chunks: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the log loss; weights undo the sampling of classes when Platt scaling is fitted.

    In an epoch, a text longer than most_chunks chunks takes part with that many, drawn anew at random from
    all of it. One text in eight is kept for the scaling, which scores it whole.
    """
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = Network(f32(WIDTH, 256, FILTERS, scale=0.1), np.zeros(FILTERS, np.float32), f32(3 * FILTERS, HIDDEN, scale=0.15), np.zeros(HIDDEN, np.float32), f32(HIDDEN, scale=0.3), np.zeros(1, np.float32))
    params = [net.filters, net.shift, net.hidden, net.hidden_shift, net.out, net.out_shift]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    every = [chunks_of(t) for t in texts]
    learn = np.array([k for k in range(len(texts)) if k % 8 != 7], np.int64)
    held = [k for k in range(len(texts)) if k % 8 == 7] or learn.tolist()
    step, total = 0, epochs * max(1, -(-len(learn) // batch))
    for _ in range(epochs):
        order = rng.permutation(learn)
        for at in range(0, len(order), batch):
            these = order[at : at + batch]
            parts = [every[k] if len(every[k]) <= most_chunks else every[k][np.sort(rng.choice(len(every[k]), most_chunks, replace=False))] for k in these]
            chunks, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            starts = np.cumsum(sizes) - sizes
            z = net.convolved(chunks)
            where = z.argmax(axis=1)
            top = np.take_along_axis(z, where[:, None], axis=1)[:, 0] + net.shift
            pooled = np.maximum(top, 0)
            high, low = np.maximum.reduceat(pooled, starts), np.minimum.reduceat(pooled, starts)
            x = np.concatenate([np.add.reduceat(pooled, starts) / sizes[:, None], high, low], axis=1)
            h = np.tanh(x @ net.hidden + net.hidden_shift)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.out_shift[0], -30, 30)))
            g = ((p - labels[these]) / len(these)).astype(np.float32)
            gh = np.outer(g, net.out) * (1 - h * h)
            gx = gh @ net.hidden.T
            doc = np.repeat(np.arange(len(these)), sizes)
            gp = gx[doc, :FILTERS] / sizes[doc][:, None]
            gp += gx[doc, FILTERS : 2 * FILTERS] * (pooled == high[doc]) + gx[doc, 2 * FILTERS :] * (pooled == low[doc])
            gp *= top > 0
            gf = np.zeros_like(net.filters)
            rows = np.arange(len(chunks))[:, None]
            columns = np.broadcast_to(np.arange(FILTERS), gp.shape)
            for k in range(WIDTH):
                np.add.at(gf[k], (chunks[rows, where * STEP + k], columns), gp)
            grads = [gf, gp.sum(axis=0), x.T @ gh, gh.sum(axis=0), h.T @ g, np.array([g.sum()], np.float32)]
            step += 1
            lr = rate * (1 - step / (total + 1))
            for v, m, s, d in zip(params, first, second, grads, strict=True):
                m += 0.1 * (d - m)
                s += 0.01 * (d * d - s)
                v -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    z = np.array([net.logits(net.pooled(every[k]), np.array([0]))[0] for k in held])
    net.scale = _platt(z, labels[held], weights[held])
    return net


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits by weighted logistic regression (Newton steps, lightly damped)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, v = w * (p - y), w * p * (1 - p)
        g = np.array([r @ z + 1e-2 * (a - 1), r.sum() + 1e-2 * b])
        hess = np.array([[v @ (z * z) + 1e-2, v @ z], [v @ z, v.sum() + 1e-2]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(da, -0.5, 0.5)), b - float(np.clip(db, -0.5, 0.5))
    return max(a, 0.05), b


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn_from: Column, per_class: int) -> Network | None:
    """A network of a sample of about per_class documents of each class, within the bytes that sampling.py names; None unless there are both."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter(F.col("_label").isin(0, 1)).withColumnRenamed("_id", id_col).filter(learn_from)
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    # about 2 * per_class ids, first with the sizes of their texts
    sample = F.broadcast(sample_by_class(known, id_col, "_label", per_class))
    given = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull())
    chosen = within_bytes(given.select(id_col, F.octet_length(text_col).alias("_bytes")).join(sample, id_col), id_col, "_label")
    rows = given.join(F.broadcast(chosen.distinct()), id_col).collect()
    rows = sorted(rows, key=lambda r: (order_of(r[0]), r[2], r[1]))
    if len({r[2] for r in rows}) < 2:
        return None
    y = np.array([r[2] for r in rows], np.float64)
    taken = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    w = np.array([counts[r[2]] / taken[r[2]] for r in rows])
    return train([r[1].encode() for r in rows], y, w / w.mean())


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 4, held_fold: int = 2, per_class: int = 1500, threshold: float = 0.7,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The network learns from labelled documents outside the held fold; its size is fixed, so it is
    sent to the executors as it is. A null text counts as empty and is scored as one chunk of zero
    bytes. Every score is 0.5 if the labels don't show both classes. Labels of documents that
    don't exist, or that are neither 0 nor 1, are not used; of a label given twice each row counts.
    The whole text is scored, in its row, however long; repeated rows get the same score, and an
    empty table gives an empty result.
    """
    held = fold(id_col, folds) == held_fold
    net = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col, ~held, per_class))
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 1000) for k in range(0, max(1, whole.num_rows), 1000)):
                texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
                s = np.full(len(texts), 0.5) if net.value is None else net.value.scores(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(id_col, held.alias("_held"), text_col).mapInArrow(scored, f"doc_id {id_type}, held_out boolean, score double, predicted int")
