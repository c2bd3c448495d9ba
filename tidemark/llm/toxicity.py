"""Toxicity scores from the nearest labelled texts by exact TF-IDF cosine (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, written
from tidemark.llm.langid import held_out
from tidemark.llm.ngrams import summed
from tidemark.llm.words import word_hashes

#: Labelled examples at most, neighbours that vote, and the weight of the prior among the votes.
EXAMPLES, NEIGHBOURS, PRIOR = 10_000, 15, 0.2
#: Weight of a term that tells nothing about labels, and the significance from which terms weigh more.
LIGHT, SURE = 0.02, 3.0
#: Groups of equal examples in a block, blocks of each text that are scored first, texts that are scored together.
BLOCK, FIRST, TOGETHER = 256, 4, 64
#: Terms in one group of so many or more are frequent, as many as fit in so many bytes: their lists are held dense.
FREQUENT, DENSE_BYTES = 16, 64 << 20
#: Bytes of text whose words are hashed at once, and a slack for rounding when cosines are compared.
CHUNK, SLACK = 4 << 20, 1e-9

#: ASCII other than letters separates words; bytes of other code points count as letters.
_GAP = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
_VECTOR = "doc_id long, toxic int, half int, terms binary, counts binary"


def term_counts(texts: list[str | None], vocabulary: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of pieces of `texts`: text numbers, terms and counts, sorted by both, and the number of texts.

    A term is a word's 64-bit hash, or its place in the sorted `vocabulary`, which leaves out others.
    """
    lo = 0
    while lo < len(texts):
        hi, size, data = lo, 0, []
        while hi < len(texts) and (hi == lo or size < CHUNK):
            data.append((texts[hi] or "").lower().encode())
            size += len(data[-1])
            hi += 1
        words, bounds = word_hashes(data, _GAP)
        own = np.repeat(np.arange(hi - lo), np.diff(bounds))
        if vocabulary is not None:
            at = np.minimum(np.searchsorted(vocabulary, words), max(0, len(vocabulary) - 1))
            known = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
            key, n = np.unique(own[known] * len(vocabulary) + at[known], return_counts=True)
            yield *np.divmod(key, max(1, len(vocabulary))), n, hi - lo
        else:
            order = np.lexsort((words, own))
            words, own = words[order], own[order]
            new = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (own[1:] != own[:-1]))[: len(words)])
            yield own[new], words[new], np.diff(np.append(new, len(words))), hi - lo
        lo = hi


def unit(row: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
    """x divided by the length of its row."""
    return x / np.sqrt(np.bincount(row, x * x, minlength=rows))[row]


class Index:
    """Block-max inverted index over unit vectors of labelled examples.

    Equal vectors are one group with the number of its examples and of the toxic ones. Groups are numbered so that those
    with the same strongest frequent term are neighbours. Rare terms have lists of postings. Frequent terms have their
    weights in blocks of BLOCK groups, each with its maxima.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, n: np.ndarray, weights: np.ndarray, toxic: np.ndarray, ids: list[int]):
        self.weights, rows = weights, len(ids)
        ends = np.searchsorted(row, np.arange(rows + 1))
        groups: dict[bytes, list[int]] = {}
        for i in range(rows):
            at = slice(ends[i], ends[i + 1])
            groups.setdefault(term[at].tobytes() + n[at].tobytes(), []).append(i)
        self.prior = (float(toxic.sum()) + 0.5) / (rows + 1)
        empty = groups.pop(b"", [])
        self.empty = (len(empty), float(toxic[empty].sum()), min((ids[i] for i in empty), default=None))
        heads = np.array([g[0] for g in groups.values()], dtype=np.int64)
        x = unit(row, self.weighted(term, n), rows)
        chosen = np.isin(row, heads)
        r, t, x = np.searchsorted(np.sort(heads), row[chosen]), term[chosen], x[chosen]
        members = sorted(groups.values())
        count = np.bincount(t, minlength=len(weights))
        fits = DENSE_BYTES // (8 * max(1, len(members)))
        by_count = np.argsort(-count, kind="stable")[:fits]
        self.frequent = np.sort(by_count[count[by_count] * FREQUENT >= max(1, len(members))])
        place = np.full(len(weights), -1)
        place[self.frequent] = np.arange(len(self.frequent))
        often = place[t] >= 0
        strongest = np.full(len(members), -1)
        order = np.lexsort((x[often], r[often]))
        strongest[r[often][order]] = t[often][order]  # the last of a row stays
        order = np.lexsort((np.arange(len(members)), strongest))
        number = np.empty(len(members), dtype=np.int64)
        number[order] = np.arange(len(members))
        members = [members[i] for i in order]
        self.of = np.full(rows, -1)
        for k, g in enumerate(members):
            self.of[g] = k
        self.blocks = -(-len(members) // BLOCK)
        size = self.blocks * BLOCK
        self.many, self.toxic = np.zeros(size), np.zeros(size)
        self.many[: len(members)] = [len(g) for g in members]
        self.toxic[: len(members)] = [toxic[g].sum() for g in members]
        self.ids = [min(ids[i] for i in g) for g in members]
        dense = np.zeros((len(self.frequent), size))
        dense[place[t[often]], number[r[often]]] = x[often]
        self.dense = np.ascontiguousarray(dense.reshape(len(self.frequent), self.blocks, BLOCK).transpose(1, 0, 2))
        self.most = self.dense.max(axis=2, initial=0.0).T
        self.place = place
        t, g, x = t[~often], number[r[~often]], x[~often]
        order = np.lexsort((g, t))
        self.group, self.x = g[order].astype(np.int32), x[order]
        self.start = np.searchsorted(t[order], np.arange(len(weights) + 1))

    def weighted(self, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (1 + np.log(n)) * self.weights[term]

    def votes(self, row: np.ndarray, term: np.ndarray, n: np.ndarray, rows: int, without: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[float, int | None, float]]:
        """For each text the share of toxic ones among the nearest examples, the nearest one's id and its cosine.

        row, term, n: the texts' terms, sorted by row. without: each text's own group, of which one example with its label is left out.
        """
        out = []
        for lo in range(0, rows, TOGETHER):
            hi = min(rows, lo + TOGETHER)
            a, b = np.searchsorted(row, [lo, hi])
            out += self._votes(row[a:b] - lo, term[a:b], n[a:b], hi - lo, None if without is None else without[lo:hi], None if label is None else label[lo:hi])
        return out

    def _votes(self, row, term, n, rows, without, label):
        x = unit(row, self.weighted(term, n), rows)
        has = np.bincount(row, minlength=rows) > 0
        scores, least = self.nearest(row, term, x, rows, without)
        out = []
        for i in range(rows):
            if not has[i]:
                m, t, name = self.empty
                m, t = (m, t) if without is None else (m - 1, t - float(label[i]))
                out.append(((t + PRIOR * self.prior) / (m + PRIOR), name, 1.0 if m else 0.0))
                continue
            own = scores[i]
            near = np.flatnonzero(own >= max(least[i] - SLACK, SLACK))
            many, toxic = self.many[near], self.toxic[near]
            if without is not None:
                many, toxic = many - (near == without[i]), toxic - (near == without[i]) * label[i]
            near, many, toxic = near[many > 0], many[many > 0], toxic[many > 0]
            last = _last(own[near], many)
            near, many, toxic = (v[own[near] >= last - SLACK] for v in (near, many, toxic))
            if not len(near):
                out.append((self.prior, None, 0.0))
                continue
            w = own[near] ** 2
            best = near[np.argmax(own[near])]
            out.append((float((w @ toxic + PRIOR * self.prior) / (w @ many + PRIOR)), self.ids[best], float(min(1.0, own[best]))))
        return out

    def nearest(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, rows: int, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines with all groups that can be among the neighbours (-1 for others), and what the last neighbour has at least.

        Rare terms are added from their lists. What frequent terms can add to a block at most follows from its maxima. The FIRST
        blocks by that bound are scored whole and give a bound for the last neighbour; of the others only those are scored that can
        reach it, so the neighbours are exact.
        """
        size = self.blocks * BLOCK
        if not self.blocks:
            return np.zeros((rows, 0)), np.zeros(rows)
        often = self.place[term] >= 0
        heavy = np.zeros((rows, len(self.frequent)))
        heavy[row[often], self.place[term[often]]] = x[often]
        t, r = term[~often], row[~often]
        lo = self.start[t]
        n = self.start[t + 1] - lo
        places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        scores = np.bincount(np.repeat(r, n) * size + self.group[places], self.x[places] * np.repeat(x[~often], n), minlength=rows * size).astype(float, copy=False).reshape(rows, self.blocks, BLOCK)
        bound = scores.max(axis=2) + heavy @ self.most
        top = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        done = np.zeros((rows, self.blocks), dtype=bool)
        np.put_along_axis(done, top, True, axis=1)
        self._score(heavy, scores, done)
        least = np.zeros(rows)
        for i in range(rows):
            group = (top[i][:, None] * BLOCK + np.arange(BLOCK)).ravel()
            least[i] = _last(scores[i, top[i]].ravel(), self.many[group] - (0 if without is None else group == without[i]))
        rest = ~done & (bound >= np.maximum(least - SLACK, SLACK)[:, None])
        self._score(heavy, scores, rest)
        scores[~(done | rest)] = -1.0
        return scores.reshape(rows, size), least

    def _score(self, heavy: np.ndarray, scores: np.ndarray, which: np.ndarray) -> None:
        for block in np.flatnonzero(which.any(axis=0)):
            own = which[:, block]
            scores[own, block] += heavy[own] @ self.dense[block]


class Recipe:
    """What an Index is made of. It is small, and each worker makes the index once."""

    def __init__(self, *parts):
        self.parts, self.made = parts, None

    def index(self) -> Index:
        if self.made is None:
            self.made = Index(*self.parts)
        return self.made


def _last(scores: np.ndarray, many: np.ndarray) -> float:
    """The cosine of the last of the neighbours among groups of so many examples each (0 if there are fewer)."""
    if len(scores) > 2 * NEIGHBOURS:  # one group may be empty
        top = np.argpartition(-scores, NEIGHBOURS)[: NEIGHBOURS + 1]
        scores, many = scores[top], many[top]
    some = (scores > 0) & (many > 0)
    scores, many = scores[some], many[some]
    order = np.argsort(-scores, kind="stable")
    at = int(np.searchsorted(np.cumsum(many[order]), NEIGHBOURS))
    return float(scores[order[at]]) if at < len(order) else 0.0


def relevance(toxic: np.ndarray, clean: np.ndarray, texts: tuple[float, float]) -> np.ndarray:
    """The weight of each term by how surely it is more frequent in toxic texts: LIGHT for most, up to 1.

    toxic, clean: texts of either label that have the term; texts: how many there are. No term is left out.
    """
    share = texts[0] / max(1.0, sum(texts))
    expected = (toxic + clean) * share
    z = (toxic - expected) / np.sqrt(expected * (1 - share) + 1)
    return LIGHT + (1 - LIGHT) * np.maximum(0.0, 1 - (SURE / np.maximum(z, SURE)) ** 2)


def platt(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes' log-odds, by Newton's method with a small ridge."""
    x = np.stack([logit(votes), np.ones(len(votes))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - y) + (w - [1.0, 0.0]))
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 0.05)), float(w[1])


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def examples_of(labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, toxic and half of at most `limit` labelled ids outside the held-out fold, chosen by a hash of the id."""
    clean = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("examples"))
    return clean.orderBy(order, "doc_id").limit(limit).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.pmod(order, F.lit(2)).cast("int").alias("half"))


def example_vectors(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, toxic, half and the terms and counts of the chosen documents; of rows with the same doc_id the least terms."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = [], []
            for row, term, n, texts in term_counts(batch.column("text").to_pylist()):
                ends = np.searchsorted(row, np.arange(texts + 1))
                terms += [term[a:b].astype("<u8").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                counts += [n[a:b].astype("<u4").tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "toxic", "half")), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "toxic", "half", "terms", "counts"])

    found = docs.select("doc_id", "text").join(small(chosen), "doc_id").select("doc_id", "toxic", "half", "text").mapInArrow(vectors, _VECTOR)
    return found.groupBy("doc_id", "toxic", "half").agg(F.min(F.struct("terms", "counts")).alias("v")).select("doc_id", "toxic", "half", "v.*")


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted, and as evidence nearest_id and nearest_cosine, of each row of `docs` (doc_id, text).

    labels (doc_id, toxic): what to learn from; of an id with several labels the largest counts, ids of the held-out fold
    (see `held_out`) are left out, and so are null ones. At most `examples` of them, chosen by hash, are indexed with all their
    words, lower-cased. Document frequencies come from all rows of `docs`. A term's weight is its IDF times a
    relevance, which one half of the examples sets (see `relevance`); the votes of the other half, each without itself,
    calibrate the score. Every text is looked up whole: its neighbours are the examples with the largest cosine over the
    terms of the index. The driver gets the examples' vectors, the terms' counts and the calibration's votes, all bounded by
    `examples`; what the index is made of is broadcast.

    Null or empty text, or one without a term of the index: the vote of the examples that have none either. No examples:
    a score of one half. Null doc_id: kept, held out. Repeated rows: each by itself, but one example for an id. No rows: no rows.
    Other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    table = written(example_vectors(slim, written(examples_of(labels, examples))))
    rows = sorted(table.collect(), key=lambda r: r.doc_id)
    toxic, half = np.array([float(bool(r.toxic)) for r in rows]), np.array([r.half for r in rows], dtype=np.int64)
    n = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r.counts, "<u4") for r in rows)])
    row = np.repeat(np.arange(len(rows)), [len(r.counts) // 4 for r in rows])
    vocabulary, term = np.unique(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(r.terms, "<u8") for r in rows)]), return_inverse=True)
    ids = [r.doc_id for r in rows]
    del rows
    shared_terms = context.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(len(shared_terms.value) + 1, dtype="<i8")
        for batch in batches:
            for _, own, _, texts in term_counts(batch.column("text").to_pylist(), shared_terms.value):
                total[:-1] += np.bincount(own, minlength=len(total) - 1)
                total[-1] += texts
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    counts = summed(slim.select("text").mapInArrow(count, "part long, v binary"))
    if counts is None:
        counts = np.zeros(len(vocabulary) + 1)
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    first = half[row] == 0
    seen = [np.bincount(term[first & (toxic[row] == y)], minlength=len(vocabulary)).astype(float) for y in (1.0, 0.0)]
    weights = idf * relevance(*seen, (float(((half == 0) & (toxic == 1)).sum()), float(((half == 0) & (toxic == 0)).sum())))
    shared = context.broadcast(Recipe(row.astype(np.int32), term.astype(np.int32), n, weights, toxic, ids))
    del row, term, n

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(c.as_buffer(), "<u4") for c in batch.column("counts"))])
            row = np.repeat(np.arange(batch.num_rows), [len(c.as_buffer()) // 4 for c in batch.column("counts")])
            term = np.searchsorted(shared_terms.value, np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(c.as_buffer(), "<u8") for c in batch.column("terms"))]))
            own, y = np.searchsorted(shared.value.parts[-1], batch.column("doc_id")), np.asarray(batch.column("toxic")).astype(bool).astype(float)
            index = shared.value.index()
            votes = index.votes(row, term, n, batch.num_rows, index.of[own], y)
            yield pa.record_batch([pa.array([v[0] for v in votes], pa.float64()), pa.array(y)], names=["vote", "y"])

    parts = 2 * context.defaultParallelism
    second = table.where("half = 1").repartition(parts, "doc_id").mapInArrow(itself, "vote double, y double").orderBy("vote", "y").collect()
    y = np.array([r.y for r in second])
    slope, offset = platt(np.array([r.vote for r in second]), y) if 0 < y.sum() < len(y) else (1.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, term, n, texts in term_counts(batch.column("text").to_pylist(), shared_terms.value):
                found += shared.value.index().votes(row, term, n, texts)
            p = 1 / (1 + np.exp(-(slope * logit(np.array([f[0] for f in found], dtype=float)) + offset)))
            out = [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())]
            yield pa.record_batch(out, names=["doc_id", "held_out", "score", "predicted", "nearest_id", "nearest_cosine"])

    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, nearest_id long, nearest_cosine double")
