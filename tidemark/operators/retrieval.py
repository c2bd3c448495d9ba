"""Retrieving similar visits through shared labels, and similarity of sampled pairs."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import clauses
from tidemark.functions.sets import field_set, jaccard, r6
from tidemark.operators.broadcasts import held, small, stored
from tidemark.operators.checks import pick_by_index
from tidemark.operators.resample import draw
from tidemark.operators.splits import hash_rank


def profile(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, rid, items, and what visits are compared by: tokens, patterns, diseases."""
    return rows.select(*keys, "rid", "items", F.array_distinct(clauses(F.col("text_long"))).alias("tokens"), field_set(F.col("labels"), "pattern").alias("patterns"), field_set(F.col("labels"), "disease").alias("diseases"))


#: Sets of tokens of a label, and sets that ask for it, up to which they meet in one task; those compared at a time; and sets a task holds, about.
CELLS, ASKS, BLOCK, HELD = 32_768, 4096, (2048, 512), 20_000

LISTS = "key string, t string, n long, found array<struct<s:int,rid:long>>"
_FOUND = pa.struct([("s", pa.int32()), ("rid", pa.int64())])
_LOW = 0xFFFFFFFF


def _sets(column: pa.ChunkedArray, names: dict[str, int], learn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of token sets in JSON: each set's size, where its tokens' numbers begin and how many these are, and all numbers.

    names: token -> number; new tokens are added to it or left out of the numbers.
    """
    sizes, counts, flat = [], [], []
    for text in column.to_pylist():
        tokens = json.loads(text)
        own = [names.setdefault(x, len(names)) for x in tokens] if learn else [names[x] for x in tokens if x in names]
        sizes.append(len(tokens))
        counts.append(len(own))
        flat += own
    counts = np.array(counts, np.int64)
    return np.array(sizes, np.int64), np.cumsum(counts) - counts, counts, np.array(flat, np.int64)


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of all values of lists that begin at `starts` and have `counts` values."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _matrix(sets: tuple, rows: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A row for each of the sets, with a one for each of its tokens that `at` gives a column."""
    _, starts, counts, flat = sets
    own = np.zeros((len(rows), width), np.float32)
    row, column = np.repeat(np.arange(len(rows)), counts[rows]), at[flat[_places(starts[rows], counts[rows])]]
    own[row[column >= 0], column[column >= 0]] = 1
    return own


def _by_value(column: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The rows of each value."""
    codes = column.combine_chunks().dictionary_encode()
    numbers = np.asarray(codes.indices)
    order = np.argsort(numbers, kind="stable")
    return dict(zip(codes.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(numbers))[:-1]), strict=True))


def _nearest_cells(asked: tuple, q: np.ndarray, cells: tuple, rows: np.ndarray, most: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """For each asking set the `most` most similar of the cells `rows`, of equal ones the first: similarity in units of 1e-9, place in `rows`."""
    at = np.full(tokens + 1, -1)
    used = np.unique(asked[3][_places(asked[1][q], asked[2][q])])
    at[used] = np.arange(len(used))
    theirs, best = _matrix(asked, q, at, len(used)), np.empty((len(q), 0), np.int64)
    for start in range(0, len(rows), BLOCK[0]):
        part = rows[start : start + BLOCK[0]]
        both = (theirs @ _matrix(cells, part, at, len(used)).T).astype(float)
        near = both / np.maximum(asked[0][q][:, None] + cells[0][part][None, :] - both, 1)
        score = (np.rint(np.round(near, 9) * 1e9).astype(np.int64) << 32) | (_LOW - start - np.arange(len(part)))
        best = np.concatenate([best, score], axis=1)
        if best.shape[1] > most:
            best = np.partition(best, best.shape[1] - most, axis=1)[:, -most:]
    best = -np.sort(-best, axis=1)
    return best >> 32, _LOW - (best & _LOW)


def _meet(cap: int, least: int):
    """A function over the cells and the asking sets of some labels (a cogroup) that makes LISTS."""

    def tile(cells: pa.Table, asks: pa.Table) -> pa.Table:
        parts = [pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.list_(_FOUND))], names=["key", "t", "n", "found"])]
        if not cells.num_rows or not asks.num_rows:
            return parts[0]
        names: dict[str, int] = {}
        asked, own = _sets(asks["q_t"], names, True), _sets(cells["t"], names, False)
        lists = cells["rids"].combine_chunks()
        lengths, rids = np.asarray(pc.list_value_length(lists), dtype=np.int64), np.asarray(lists.flatten())
        starts = np.cumsum(lengths) - lengths
        where, texts = _by_value(cells["key"]), asks["q_t"].combine_chunks()
        for key, mine in _by_value(asks["q_key"]).items():
            if key not in where:
                continue
            rows = where[key][np.argsort(rids[starts[where[key]]], kind="stable")]  # of equally similar cells, those that begin with smaller ids win
            n = int(lengths[rows].sum())
            need = cap if n >= least else n
            for k in range(0, len(mine), BLOCK[1]):
                q = mine[k : k + BLOCK[1]]
                sim, place = _nearest_cells(asked, q, own, rows, min(need, len(rows)), len(names))
                cell = rows[place]
                count = np.minimum(lengths[cell], need)
                before = np.cumsum(count, axis=1) - count
                changes = np.diff(sim, axis=1, prepend=-1) != 0
                level = np.maximum.accumulate(np.where(changes, np.arange(sim.shape[1]), 0), axis=1)
                stay = np.take_along_axis(before, level, axis=1) < need  # cells behind `need` ids that are nearer can't add one
                count = count[stay]
                rid, less = rids[_places(starts[cell[stay]], count)], np.repeat(-sim[stay], count)
                ask = np.repeat(np.nonzero(stay)[0], count)
                order = np.lexsort((rid, less, ask))
                order = order[np.arange(len(ask)) - np.searchsorted(ask, ask) < need]
                ends = pa.array(np.searchsorted(ask[order], np.arange(len(q) + 1)), pa.int32())
                values = pa.StructArray.from_arrays([pa.array(less[order], pa.int32()), pa.array(rid[order], pa.int64())], fields=list(_FOUND))
                columns = [pa.array([key] * len(q), pa.string()), texts.take(pa.array(q)).cast(pa.string()), pa.array(np.full(len(q), n)), pa.ListArray.from_arrays(ends, values)]
                parts.append(pa.table(columns, names=["key", "t", "n", "found"]))
        return pa.concat_tables([x.cast(parts[0].schema) for x in parts])

    return tile


def _valued(rows: DataFrame, field: str) -> DataFrame:
    return rows.withColumn("key", F.explode(F.array_distinct(field))).where("key IS NOT NULL")


def _lists(classes: DataFrame, pool: DataFrame, field: str, cap: int, least: int) -> DataFrame:
    """LISTS: for each label and each set of tokens t of a class that has it, the nearest visits of the pool that have the label.

    s is minus the similarity in units of 1e-9. A list has the `cap` nearest visits (ties: smaller rid) and n of at least `least`, or all n visits
    if these are fewer. A label's visits with equal tokens are one cell. A label of many cells is dealt into shards, one of many
    asking sets into blocks, and each (shard, block) makes lists of its own.
    """
    asks = stored(_valued(classes.select("t", field), field).select(F.col("key").alias("q_key"), F.col("t").alias("q_t")).distinct())
    asked_for = small(asks.select("q_key").distinct())
    own = _valued(pool.select("rid", "t", field), field).join(asked_for, F.col("key") == F.col("q_key"), "left_semi").select("key", "t", "rid")
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("key", "t").orderBy("rid"))).where(F.col("r") <= max(cap, least))
    cells = stored(ranked.groupBy("key", "t").agg(F.sort_array(F.collect_list("rid")).alias("rids")))
    met = cells.groupBy("key").agg(F.count("*").alias("_c")).join(asks.groupBy(F.col("q_key").alias("key")).agg(F.count("*").alias("_a")), "key")
    hot = small(met.select("key", F.ceil(F.col("_c") / CELLS).alias("shards"), F.ceil(F.col("_a") / ASKS).alias("blocks")).where("shards > 1 OR blocks > 1"))
    many, one = max(8 * cells.sparkSession.sparkContext.defaultParallelism, -(-cells.count() // HELD)), F.lit(1).cast("long")

    def dealt(rows: DataFrame, key: str, t: str, into: str, copies: str, names: list[str]) -> DataFrame:
        kinds = rows.join(hot.withColumnRenamed("key", key), key, "left").withColumn("g", F.pmod(F.xxhash64(key), F.lit(many)))
        kinds = kinds.withColumn("of", F.pmod(F.xxhash64(t), F.coalesce(into, one))).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(copies, one) - 1)))
        return kinds.select(F.col("g").alias(names[0]), F.col("of").alias(names[1]), F.col("copy").alias(names[2]), *rows.columns)

    left, right = ["g", "shard", "block"], ["q_g", "q_block", "q_shard"]
    of_cells = dealt(cells, "key", "t", "shards", "blocks", left).repartition(many, *left)
    of_asks = dealt(asks, "q_key", "q_t", "blocks", "shards", right).repartition(many, "q_g", "q_shard", "q_block")
    return of_cells.groupBy(*left).cogroup(of_asks.groupBy("q_g", "q_shard", "q_block")).applyInArrow(_meet(cap, least), LISTS)


def _merged(found: DataFrame, cap: int, least: int) -> DataFrame:
    """c, enough and found: of each class all lists as one, each visit once; the `cap` nearest if there are at least `least`, else all."""
    lists = found.groupBy("c").agg(F.max("n").alias("n"), F.sort_array(F.flatten(F.collect_list("found"))).alias("a"))
    once = lists.select("c", "n", F.expr("filter(a, (x, i) -> i = 0 OR x.rid <> a[i - 1].rid)").alias("a"))
    enough = F.greatest("n", F.size("a")) >= least
    return once.select("c", enough.alias("enough"), F.when(enough, F.slice("a", 1, cap)).otherwise(F.col("a")).alias("found"))


def nearest(queries: DataFrame, pool: DataFrame, cap: int, least: int) -> DataFrame:
    """q and found: for each query that has any, its candidates as structs (rank, rid, j, adds, deletes); see `candidates`. No query is in the pool."""
    tokens = F.array_compact(F.coalesce("tokens", F.array().cast("array<string>")))
    keyed = lambda rows: rows.withColumn("t", F.to_json(F.sort_array(F.array_distinct(tokens))))
    alike = Window.partitionBy("t", "patterns", "diseases")
    asked = stored(keyed(queries).select("rid", "items", "t", "patterns", "diseases").withColumn("c", F.min("rid").over(alike)))
    classes, others = asked.where("rid = c").select("c", "t", "patterns", "diseases"), keyed(pool)

    def found(of: DataFrame, field: str) -> DataFrame:
        return _valued(of.select("c", "t", field), field).select("c", "t", "key").join(_lists(of, others, field, cap, least), ["key", "t"]).select("c", "n", "found")

    best = stored(_merged(found(classes, "patterns"), cap, least))
    few = held(classes.join(best.where("enough").select("c"), "c", "left_anti"))
    if few.limit(1).count():
        sparse = best.where("NOT enough").select("c", F.lit(0).cast("long").alias("n"), "found")
        best = best.where("enough").unionByName(_merged(found(few, "diseases").unionByName(sparse), cap, least))
    ranked = best.select("c", F.posexplode(F.slice("found", 1, cap)).alias("at", "x")).select("c", (F.col("at") + 1).alias("rank"), "x.rid")
    items = ranked.join(pool.select("rid", "items"), "rid").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("rank", "rid", "items"))).alias("found"))
    each = asked.select("c", F.col("rid").alias("q"), F.col("items").alias("own")).join(items, "c")
    own = F.col("own")
    return each.select("q", F.transform("found", lambda x: F.struct(
        x["rank"].alias("rank"), x.rid.alias("rid"), F.round(jaccard(x["items"], own), 9).alias("j"),
        F.size(F.array_except(own, x["items"])).alias("adds"), F.size(F.array_except(x["items"], own)).alias("deletes"),
    )).alias("found"))


def candidates(queries: DataFrame, pool: DataFrame, cap: int, least: int) -> DataFrame:
    """For each query the `cap` most similar visits of the pool by tokens (ties: smaller rid) among those that share a pattern,
    or, if these are fewer than `least`, also those that share a disease. Queries aren't candidates.

    Every query is answered, however many there are, and none goes through the driver. A list is made once for each label and set of tokens
    that a query has, from the label's distinct sets of tokens, as products of matrices; a query merges the lists of its labels. So a
    pair is never a row unless it is in a list, and the number of rows that meet doesn't depend on how common a label is.
    Queries must not repeat a rid.
    """
    others = pool.join(queries.select(F.col("rid").alias("q")), F.col("rid") == F.col("q"), "left_anti")
    return nearest(queries, others, cap, least).select("q", F.inline("found"))


def ceiling(found: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Of what `nearest` gives: for each k the best item similarity among the first k candidates: median, mean, shares of at least .5 and .7, and what the best one lacks and has too much."""
    firsts = [F.array_min(F.transform(F.filter("found", lambda x: x["rank"] <= k), lambda x: F.struct((-x.j).alias("m"), x["rank"], x.adds.alias("adds"), x.deletes.alias("deletes")))) for k in ks]  # noqa: B023
    best = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), b.alias("b")) for k, b in zip(ks, firsts, strict=True)])).alias("x"))
    best = held(best.select("x.k", (-F.col("x.b.m")).alias("j"), "x.b.adds", "x.b.deletes"))
    median = pick_by_index(best, ["k"], "j", {"median": F.expr("c div 2")}).select("k", r6(F.col("median")).alias("median"))
    rest = best.groupBy("k").agg(F.count("*").alias("queries"), r6(F.avg("j")).alias("mean"), r6(F.avg((F.col("j") >= 0.5).cast("int"))).alias("half"), r6(F.avg((F.col("j") >= 0.7).cast("int"))).alias("most"), r6(F.avg("adds")).alias("adds"), r6(F.avg("deletes")).alias("deletes"))
    return rest.join(median, "k").select("k", "queries", "median", "mean", "half", "most", "adds", "deletes")


def pair_similarity(rows: DataFrame, n_pairs: int, seed=3) -> DataFrame:
    """Mean item similarity of sampled pairs of different visits: all, those that share a pattern, those that don't, and those that share disease and pattern."""
    numbered = held(hash_rank(profile(rows), "rid").select((F.col("_rank") - 1).alias("ix"), "items", "patterns", "diseases"))
    n = numbered.count()
    pairs = rows.sparkSession.range(n_pairs).select((draw(F.col("id"), "a", seed) % max(n, 1)).alias("a"), (draw(F.col("id"), "b", seed) % max(n, 1)).alias("b")).where("a <> b")
    x = numbered.select(F.col("ix").alias("a"), F.struct("items", "patterns", "diseases").alias("x"))
    y = numbered.select(F.col("ix").alias("b"), F.struct("items", "patterns", "diseases").alias("y"))
    both = pairs.join(x, "a").join(y, "b")
    same, disease = F.arrays_overlap("x.patterns", "y.patterns"), F.arrays_overlap("x.diseases", "y.diseases")
    kinds = F.array_compact(F.array(F.lit("all"), F.when(same, "same").otherwise("different"), F.when(same & disease, "same_both")))
    return both.select(jaccard(F.col("x.items"), F.col("y.items")).alias("j"), F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg("j")).alias("jaccard"))
