"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its byte n-grams, hashed into BUCKETS rows; a linear
softmax over that average gives the languages. Both are trained together by stochastic gradient
descent in numpy on a bounded sample. Since average and softmax are linear, embeddings and output
weights fold into one table for scoring, and a text's scores are the mean of table rows.

The softmax's temperature is calibrated on texts kept out of training, and so is the score below
which a prediction is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.sampling import fold, order_of, sample_by_class, within_bytes

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
#: Bytes that are hashed at a time; a longer text is summed piece by piece.
BLOCK = 1 << 20
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, float32
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, max(len(text), 1), BLOCK):
            for h in grams(text[at : at + BLOCK + max(ORDERS) - 1], min(BLOCK, len(text) - at)):
                total += self.table.take(h, axis=0).sum(axis=0)
                n += len(h)
        return softmax((total / max(n, 1) + self.bias) / self.temperature)


def grams(text: bytes, starts: int) -> list[np.ndarray]:
    """Buckets of the n-grams of each order that begin at the first ``starts`` bytes."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(b), np.uint32)
    for k in range(max(ORDERS)):
        n = len(b) - k
        if n <= 0:
            break
        h = (h[:n] * np.uint32(0x01000193)) ^ (b[k:] + np.uint32(1 + k))
        if k + 1 in ORDERS:
            mixed = h * np.uint32(0x9E3779B1)
            out.append((mixed >> np.uint32(17))[: max(starts, 0)].astype(np.int64))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares."""
    found = grams(text, len(text))
    if not sum(map(len, found)):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    index, count = np.unique(np.concatenate(found), return_counts=True)
    return index, (count / count.sum()).astype(np.float32)


def train(texts: list[bytes], labels: list[str], epochs: int = 4, rate: float = 2.0, reject_share: float = 0.005, seed: int = 5) -> LanguageModel:
    """SGD over whole texts and random pieces of them; one text in ten only calibrates."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    answers = np.array([languages.index(x) for x in labels])
    emb = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    out += rng.standard_normal(out.shape).astype(np.float32) * 0.1
    examples, held = [], []
    for k, text in enumerate(texts):
        pieces = [text]
        for size in (24, 60, 200, 800):
            if len(text) > size:
                at = int(rng.integers(0, len(text) - size + 1))
                pieces.append(text[at : at + size])
        (held if k % 10 == 9 else examples).extend((*_features(p), answers[k]) for p in pieces)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            index, share, answer = examples[k]
            lr = rate * (1 - done / steps)
            done += 1
            x = share @ emb[index]
            g = softmax(x @ out + bias)
            g[answer] -= 1
            back = out @ g
            out -= lr * np.outer(x, g)
            bias -= 0.05 * lr * g
            emb[index] -= lr * np.outer(share, back)
    table = (emb @ out).astype(np.float32)
    check = held or examples
    logits = np.array([share @ table[index] + bias for index, share, _ in check])
    truth = np.array([a for *_, a in check])

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    temperature = min(np.geomspace(0.05, 4.0, 60), key=loss)
    right = logits.argmax(axis=1) == truth
    best = np.array([softmax(z / temperature).max() for z in logits])
    reject = float(np.quantile(best[right], reject_share)) if right.any() else 0.0
    return LanguageModel(languages, table, bias, float(temperature), reject)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn_from: Column, per_language: int) -> LanguageModel | None:
    """A model of a sample of about per_language documents of each language, within the bytes that sampling.py names; None without any."""
    known = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    sample = sample_by_class(known.select("_id", "_lang", F.octet_length("_text").alias("_bytes")), "_id", "_lang", per_language)
    # at most sampling.MOST_ROWS ids, or one for each language
    chosen = F.broadcast(within_bytes(sample, "_id", "_lang").distinct())
    rows = sorted(known.join(chosen, ["_id", "_lang"]).select("_id", "_text", "_lang").collect(), key=lambda r: (order_of(r[0]), r[1], r[2]))
    return train([r[1].encode() for r in rows], [r[2] for r in rows]) if rows else None


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1, per_language: int = 600) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    The model learns from the text and non-null language of documents outside the held fold; its
    size is fixed, so it is sent to the executors as it is. A text that is null or has no letter
    is ``und`` with score 0, as is any text if there was nothing to learn from. The whole text is
    scored, in its own row. Repeated rows get the same prediction; of languages that tie, the first by
    code point is predicted. An empty table gives an empty result.
    """
    held = fold(id_col, folds) == held_fold
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, ~held, per_language))
    id_type = docs.schema[id_col].dataType.simpleString()

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for value in batch.column(2):
                text = value.as_py()
                if m is None or text is None or not any(map(str.isalpha, text)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = m.probabilities(text.encode())
                    langs.append(m.languages[int(p.argmax())])
                    scores.append(float(p.max()))
                rejected.append(m is None or scores[-1] < m.reject_below)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(id_col, held.alias("_held"), text_col).mapInArrow(predicted, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, rejected boolean")
