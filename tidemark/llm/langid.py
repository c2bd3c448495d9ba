"""Language identification by sparse multinomial logistic regression on TF-IDF n-grams (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, written
from tidemark.llm.ngrams import counted, grams, letters, summed

#: Character n-grams of these lengths, hashed to 2^BITS features.
SIZES, BITS = range(1, 6), 18
#: At most so many documents of each language fit the weights and the temperature; one in PART of them is for the temperature.
PER_LANGUAGE, PART = 1000, 4
#: Follow-the-regularised-leader: learning rate, smoothing, and the weights of the elastic net; SCALE multiplies the features.
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.02, 1e-4, 2, 20.0
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # features x languages: IDF times weight times SCALE over temperature
    bias: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its calibrated probability; UNKNOWN and 0 if the text is null or has no letter."""
        if not self.langs or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.langs)), 0
        data = letters(text)
        for h in grams(data, SIZES, BITS) if len(data) else []:
            total += self.table[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        p = softmax(total / max(n, 1) + self.bias)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


EMPTY = Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))


def has_letter(text: str) -> bool:
    return text[:1].isalpha() or any(map(str.isalpha, text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, features: int) -> np.ndarray:
    """Weights (features x classes) by FTRL-Proximal with elastic-net penalties; rows are (feature numbers, values)."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for (at, x), k in zip(rows, y, strict=True):
            za, na = z[at], n[at]
            w = weights(za, na)
            p = softmax(x @ w)
            p[k] -= 1
            g = x[:, None] * p
            more = na + g * g
            z[at] = za + g - (np.sqrt(more) - np.sqrt(na)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def temperature(margins: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the margins with the highest likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        x = margins / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(y)), y]))

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_counts(train: DataFrame) -> np.ndarray | None:
    """How many texts of `train` (text) have each feature, and behind these the number of texts; None if there is none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, docs, seen = np.zeros(1 << BITS, dtype=np.int64), 0, np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                data = letters(text)
                for h in grams(data, SIZES, BITS) if len(data) else []:
                    seen[h] = True
                at = np.flatnonzero(seen)
                total[at] += 1
                seen[at] = False
                docs += 1
        if docs:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([np.append(total, docs).tobytes()], pa.binary())], names=["part", "v"])

    return summed(train.select("text").mapInArrow(count, "part long, v binary"))


def chosen(train: DataFrame, per_language: int) -> DataFrame:
    """lang, text and a number (order) of at most `per_language` distinct rows of each language, by a hash of doc_id and text; all rows of rare languages."""
    train = train.withColumn("order", F.xxhash64("doc_id", "text"))
    counts = written(train.groupBy("lang").agg(F.approx_count_distinct("order").alias("n")))
    share = F.least(F.lit(1.0), 2.0 * per_language / F.col("n"))
    some = train.join(small(counts), "lang").where(F.shiftrightunsigned("order", 11) / float(1 << 53) < share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    return some.groupBy("lang", "order").agg(F.first("text").alias("text")).withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")


def fitted(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """A model of (language, features, counts) rows: each PART-th row of a language sets the temperature, the others the weights."""
    langs = sorted({r[0] for r in rows})
    bias_at = len(idf)
    xs = [(np.append(at.astype(np.int64), bias_at), np.append(n / n.sum() * idf[at] * SCALE, 1.0).astype(np.float32)) for _, at, n in rows]
    y = np.array([langs.index(r[0]) for r in rows], dtype=np.int64)
    later = np.zeros(len(rows), dtype=bool)
    for k in range(len(langs)):
        later[np.flatnonzero(y == k)[PART - 1 :: PART]] = True
    w = ftrl([xs[i] for i in np.flatnonzero(~later)], y[~later], len(langs), bias_at + 1)
    margins = np.array([xs[i][1] @ w[xs[i][0]] for i in np.flatnonzero(later)]).reshape(-1, len(langs))
    t = temperature(margins, y[later])
    return Model(langs, (w[:bias_at] * idf[:, None] * SCALE / t).astype(np.float32), w[bias_at] / t)


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits a model on `train` (doc_id, text, lang). IDF counts all its rows; the weights see a bounded sample of each language (see `chosen`).

    The sample is fitted in one task; the driver gets the feature counts (one row) and the model, 2^BITS numbers a language.
    """
    train = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = document_counts(train)
    if counts is None:
        return EMPTY
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, order, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "order", "text")), strict=True):
                at, n = counted(letters(text), SIZES, BITS)
                if len(at):
                    yield pa.record_batch([pa.array([lang]), pa.array([order], pa.int64()), pa.array([at.astype("<u4").tobytes()]), pa.array([n.astype("<u4").tobytes()])], names=["lang", "order", "at", "n"])

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("order", "lang", "at", "n")), strict=True))
        model = fitted([(lang, np.frombuffer(at, "<u4"), np.frombuffer(n, "<u4")) for _, lang, at, n in rows], idf)
        return pa.table({"langs": pa.array([model.langs], pa.list_(pa.string())), "weights": pa.array([model.table.tobytes()], pa.binary()), "bias": pa.array([model.bias.astype("<f8").tobytes()], pa.binary())})

    vectors = chosen(train, per_language).mapInArrow(features, "lang string, order long, at binary, n binary")
    row = vectors.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(learn, "langs array<string>, weights binary, bias binary").first()
    return Model(row.langs, np.frombuffer(row.weights, "<f4").reshape(1 << BITS, -1), np.frombuffer(row.bias, "<f8")) if row else EMPTY


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id's text is divisible by `folds` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, train: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its calibrated probability) of each row of `docs` (doc_id, text).

    train (doc_id, text, lang): the rows to learn from; null texts and languages are left out. At most `per_language` rows
    of each language fit the weights, all of a rare one, so none is missed. The model is a table of 2^BITS rows and a column a
    language, whatever the input's size; it is broadcast. A text is scored as a whole, in pieces
    if it is long. Text null or without a letter, or nothing to learn from: UNKNOWN with score 0. A tie goes to the first
    language by code point. Null doc_id: kept. Repeated rows: each by itself. No rows: no rows. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(train, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return slim.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
