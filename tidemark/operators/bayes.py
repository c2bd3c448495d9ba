"""Out-of-fold naive Bayes scores for each item, their AUC, and ablation by feature families."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sets import r6
from tidemark.operators.broadcasts import held
from tidemark.operators.splits import folds

#: Profiles that are scored at once, and profiles for each range of scores that is ranked by itself.
BLOCK, RANGE = 16_384, 500_000


def auc(scores: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """n, positives and the Mann-Whitney AUC of each group, ties averaged; null if a group has one class alone.

    Scores are counted before they are ranked, so a window holds a row for each distinct score.
    """
    counts = scores.groupBy(*keys, score).agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("n1"))
    w = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("rank", F.sum("n").over(w) - (F.col("n") - 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("rank") * F.col("n1")).alias("r"))
    value = F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * (F.col("n") - F.col("n1")))
    return out.select(*keys, "n", F.col("n1").alias("positives"), r6(value).alias("auc"))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane: small ones leave planes of zeros, which a shuffle compresses away."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _coded(places: list[tuple[str, dict[str, int]]], kind: str):
    """A function over Arrow batches: rid and, as bytes, the sorted numbers of the values that a row has in some columns of lists. places: column and the numbers of its values; others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = batch.num_rows, []
            for name, numbers in places:
                lists = batch[name]
                rows = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lists).fill_null(0)))
                values = lists.flatten().dictionary_encode()
                number = np.array([numbers.get(v, -1) for v in values.dictionary.to_pylist()] + [-1], dtype=np.int64)
                code = number[np.asarray(values.indices.fill_null(-1), dtype=np.int64)]
                found.append((rows[code >= 0] << 32) | code[code >= 0])
            both = np.unique(np.concatenate(found))
            ends = np.concatenate([[0], np.cumsum(np.bincount(both >> 32, minlength=n))]) * np.dtype(kind).itemsize
            data = (both & 0xFFFFFFFF).astype(kind).tobytes()
            codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch["rid"], codes], names=["rid", "code"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], kind: str):
    """Of each block of profiles (fold, code, n) the folds, the counts, and all numbers with the rows that have them."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            codes = part["code"].to_pylist()
            size = np.array([len(c) for c in codes]) // np.dtype(kind).itemsize
            yield part["fold"].to_numpy(), part["n"].to_numpy(), np.repeat(np.arange(len(codes)), size), np.frombuffer(b"".join(codes), kind).astype(np.int64)


def _counted(n_features: int, n_items: int, kind: str):
    """A function over profiles: how many rows of a fold have a feature and an item; number n_features stands for any row, and so does n_items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, n, rows, ids in _blocks(batches, kind):
            every = np.arange(len(n))
            feature, item = ids < n_features, ids >= n_features
            f_row, f_id = np.concatenate([rows[feature], every]), np.concatenate([ids[feature], np.full(len(n), n_features)])
            i_row, i_id = np.concatenate([rows[item], every]), np.concatenate([ids[item] - n_features, np.full(len(n), n_items)])
            order = np.argsort(i_row, kind="stable")
            i_id, many = i_id[order], np.bincount(i_row, minlength=len(n))
            first = np.cumsum(many) - many
            times = many[f_row]
            pair = np.repeat(np.arange(len(f_row)), times)
            other = i_id[np.repeat(first[f_row], times) + np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)]
            key = (fold[f_row[pair]].astype(np.int64) * (n_features + 1) + f_id[pair]) * (n_items + 1) + other
            keys, where = np.unique(key, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, where, n[f_row[pair]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], names=["key", "n"])

    return run


def _scores(constant: np.ndarray, more: np.ndarray, level_of: np.ndarray, block: tuple) -> Iterator[np.ndarray]:
    """For each level the scores of a block's profiles (row: profile, column: item) as whole numbers of 1e-9. constant: level, fold, item; more: fold, feature, item."""
    fold, n, rows, ids = block
    total = np.zeros((len(n), more.shape[2]))
    for level in range(len(constant)):
        own = np.flatnonzero(ids < len(level_of))
        own = own[level_of[ids[own]] == level]
        if len(own):
            first = np.flatnonzero(np.diff(rows[own], prepend=-1))
            total[rows[own][first]] += np.add.reduceat(more[fold[rows[own]], ids[own]], first, axis=0)
        yield np.rint((constant[level][fold] + total) * 1e9).astype(np.int64)


def _ranges(constant: np.ndarray, more: np.ndarray, level_of: np.ndarray, names: list[str], edges: list, kind: str):
    """A function over profiles: their distinct scores by level, item and range, with the number of rows and of positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, kind):
            _, n, rows, ids = block
            y = np.zeros((len(n), len(names)), np.int64)
            item = ids >= len(level_of)
            y[rows[item], ids[item] - len(level_of)] = n[rows[item]]
            out = []
            for level, scores in enumerate(_scores(constant, more, level_of, block)):
                for k, name in enumerate(names):
                    order = np.argsort(scores[:, k])
                    s = scores[order, k]
                    first = np.flatnonzero(np.diff(s, prepend=s[0] - 1))
                    s, a, b = s[first], np.add.reduceat(n[order], first), np.add.reduceat(y[order, k], first)
                    ends = [0, *np.searchsorted(s, edges[level][k]), len(s)]
                    for r, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        if j > i:
                            out.append((level, name, r, _packed(np.diff(s[i:j], prepend=0)), _packed(a[i:j]), _packed(b[i:j])))
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["level", "item", "range", "score", "n", "n1"])

    return run


def _won(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
    """Of one range: rows, positives, and twice the pairs in which the positive has the higher score (a tie counts half)."""
    score = np.concatenate([np.cumsum(_unpacked(b)) for b in got["score"]])
    n, n1 = (np.concatenate([_unpacked(b) for b in got[c]]) for c in ("n", "n1"))
    order = np.argsort(score)
    first = np.flatnonzero(np.diff(score[order], prepend=score[order[0]] - 1))
    n, n1 = np.add.reduceat(n[order], first), np.add.reduceat(n1[order], first)
    n0 = n - n1
    won = int((n1 * (2 * (np.cumsum(n0) - n0) + n0)).sum())
    return pd.DataFrame({"level": [key[0]], "item": [key[1]], "range": [key[2]], "n": [int(n.sum())], "n1": [int(n1.sum())], "won": [won]})


def naive_bayes_auc(rows: DataFrame, families: list[str], n_folds: int = 5, min_class: int = 50) -> DataFrame:
    """level, item, n, positives and auc of Bernoulli naive Bayes scores, each row scored by the other folds.

    rows: rid, items, and the families: columns of lists of features. Level k has the features of the first k + 1 families.
    rows are read several times, so they should be a stored table. Probabilities have Laplace smoothing. A row's score is
    ln(n1/n0), plus a constant as if all features were absent, plus each present feature's difference, which is the same at
    all levels. Counts of the other folds are those of all folds less the own one.

    Rows become profiles: the numbers of their features and items as bytes, counted by fold. Scores never are rows: a task
    sends the sorted distinct scores of a block of profiles as bytes, each range of scores is ranked by itself, and what
    ranges lose to lower ones follows from their counts; the result is exact, wherever ranges begin. The vocabulary and the
    model (a number for each fold, feature and item) go through the driver.
    """
    n_all = rows.count()
    seen = rows.select(F.explode("items").alias("v")).groupBy("v").count().collect()
    names = sorted(r.v for r in seen if r.v is not None and r["count"] >= min_class and n_all - r["count"] >= min_class)
    level_of, places = [], []
    for level, name in enumerate(families):
        values = sorted(r.v for r in rows.select(F.explode(name).alias("v")).distinct().collect() if r.v is not None)
        places.append((name, {v: len(level_of) + k for k, v in enumerate(values)}))
        level_of += [level] * len(values)
    n_features, n_items, level_of = len(level_of), len(names), np.array(level_of, dtype=np.int64)
    places.append(("items", {v: n_features + k for k, v in enumerate(names)}))
    out = "level int, item string, n long, positives long, auc double"
    if not n_items:
        return rows.sparkSession.createDataFrame([], out)
    kind = "<u2" if n_features + n_items < 1 << 16 else "<u4"
    coded = held(rows.select("rid", "items", *families).mapInArrow(_coded(places, kind), "rid long, code binary"))
    profiles = held(folds(coded, "rid", n_folds).groupBy("fold", "code").agg(F.count("*").alias("n")))
    n_profiles = profiles.count()
    coded.unpersist()

    cells = profiles.mapInArrow(_counted(n_features, n_items, kind), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros((n_folds, n_features + 1, n_items + 1))
    c.ravel()[cells["key"].to_numpy()] = cells["n"].to_numpy()
    c = c.sum(axis=0) - c  # of the other folds
    n1 = c[:, -1:, :-1]
    n0 = c[:, -1:, -1:] - n1
    c1 = c[:, :-1, :-1]
    c0 = c[:, :-1, -1:] - c1
    p1, p0 = (c1 + 1) / (n1 + 2), (c0 + 1) / (n0 + 2)
    absent = np.log((1 - p1) / (1 - p0))
    more = np.log(p1 / p0) - absent
    constant = np.stack([np.log(n1 / n0)[:, 0] + absent[:, level_of <= level].sum(axis=1) for level in range(len(families))])

    n_ranges = -(-n_profiles // RANGE)
    edges = [[[]] * n_items] * len(families)
    if n_ranges > 1:  # a sample sets where ranges begin, and nothing else
        some = profiles.limit(20 * n_ranges + 5000).toArrow().combine_chunks().to_batches()
        taken = [list(_scores(constant, more, level_of, b)) for b in _blocks(some, kind)]
        at = np.arange(1, n_ranges) / n_ranges
        edges = [[np.unique(np.quantile(np.concatenate([t[level][:, k] for t in taken]), at, method="nearest")) for k in range(n_items)] for level in range(len(families))]
    sent = profiles.mapInArrow(_ranges(constant, more, level_of, names, edges, kind), "level int, item string, range int, score binary, n binary, n1 binary")
    ranges = sent.groupBy("level", "item", "range").applyInPandas(_won, "level int, item string, range int, n long, n1 long, won long")
    before = Window.partitionBy("level", "item").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    lower = ranges.withColumn("lower", F.coalesce(F.sum(F.col("n") - F.col("n1")).over(before), F.lit(0)))
    total = lower.groupBy("level", "item").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("won") + 2 * F.col("n1") * F.col("lower")).alias("won"))
    return total.select("level", "item", "n", F.col("n1").alias("positives"), r6(F.try_divide(F.col("won") / 2, F.col("n1") * (F.col("n") - F.col("n1")))).alias("auc"))


def macro_by_level(aucs: DataFrame) -> DataFrame:
    """level, items, the mean AUC, and what it gains over the level before."""
    mean = aucs.where("auc is not null").groupBy("level").agg(F.count("*").alias("items"), r6(F.avg("auc")).alias("macro_auc"))
    return mean.withColumn("gain", r6(F.col("macro_auc") - F.lag("macro_auc").over(Window.orderBy("level"))))
