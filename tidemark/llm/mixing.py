"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, written

#: Weights of the sources in the order of their names (null last), repeating; share of all sizes; most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents that one node of the reduction tree pairs, on average.
FAN = 64
#: Parts of a group of rows alike, so that a large one is no single task's work.
PARTS = 1024
#: A probability this near to 0 or 1 counts as there.
NEAR = 1e-9


def sizes(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds the target of each source to `sources` (source, source_size, a row each).

    The targets are in proportion to the weights and add up to `share` of all sizes, but none exceeds `most` times its
    source's size: what one can't take is shared anew by weight. With the sources in the order of size over weight, the
    first ones reach their limit, and all others have the same multiple of their weight. Taking one more source for full
    raises that multiple as long as the source is full at it, and lowers it otherwise, so the largest one is right.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    ranked = sources.withColumn("w", weight).withColumn("limit", most * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    steps = ranked.withColumns({
        "taken_before": F.coalesce(F.sum("limit").over(before), F.lit(0.0)), "w_left": F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "wanted": share * F.sum("source_size").over(all_rows),
    }).withColumn("multiple", (F.col("wanted") - F.col("taken_before")) / F.col("w_left"))
    return steps.withColumn("target", F.least(F.col("limit"), F.max("multiple").over(all_rows) * F.col("w"))).select("source", "source_size", "target")


def _round_group(items: Column) -> Column:
    """Pairs the fractional documents of one group, in the order of their hashes, until one is left.

    items: array of (o, u, row, doc_id, size, p, whole), sorted by o, a hash. The one that is still fractional meets the next document; mass moves
    between them so that the sum of size * p stays, up to where the first of the two is 0 or 1. Which way it moves
    is drawn (u, a uniform number of the pair) so that both keep their probabilities on average. The result has the
    documents that are settled (`done`) and the one that is not (`open`, null if none).
    """
    item = "struct<o:long,u:double,row:long,doc_id:long,size:long,p:double,whole:int>"
    start = F.struct(F.expr(f"cast(array() as array<{item}>)").alias("done"), F.expr(f"cast(null as {item})").alias("open"))

    def with_p(x: Column, p: Column) -> Column:
        snapped = F.when(p < NEAR, 0.0).when(p > 1 - NEAR, 1.0).otherwise(p)
        return F.struct(x.o.alias("o"), x.u.alias("u"), x.row.alias("row"), x.doc_id.alias("doc_id"), x["size"].alias("size"), snapped.alias("p"), x.whole.alias("whole"))

    def settled(x: Column) -> Column:
        return (x.p <= 0) | (x.p >= 1)

    def step(acc: Column, x: Column) -> Column:
        a = acc.open
        up = F.least((1 - a.p) * a["size"], x.p * x["size"])  # mass that a can take from x
        down = F.least(a.p * a["size"], (1 - x.p) * x["size"])
        moved = F.when(x.u * (up + down) < down, up).otherwise(-down)
        pair = F.array(with_p(a, a.p + moved / a["size"]), with_p(x, x.p - moved / x["size"]))
        gone = F.filter(pair, settled)
        left = F.get(F.filter(pair, lambda y: ~settled(y)), F.lit(0))
        single = F.struct(F.when(settled(x), F.concat(acc.done, F.array(x))).otherwise(acc.done).alias("done"), F.when(settled(x), a).otherwise(x).alias("open"))
        paired = F.struct(F.concat(acc.done, gone).alias("done"), left.alias("open"))
        return F.when(a.isNull() | settled(x), single).otherwise(paired)

    return F.aggregate(items, start, step)


def numbered_alike(rows: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Adds to `rows` (row: long, distinct) how many are alike in `keys` (alike) and the number of each among these, from 1.

    Counts of `parts` parts of each group come first; a part's rows are numbered by themselves, from where the parts
    before it end. Rows without their like, which is most, are not sorted at all.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    group = Window.partitionBy(*keys)
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    several = written(counts.withColumns({"alike": F.sum("n").over(group), "before": F.coalesce(F.sum("n").over(before), F.lit(0))}).where("alike > 1").drop("n"))
    same = F.col("r.part") == F.col("s.part")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = dealt.alias("r").join(small(several).alias("s"), same, "left").select("r.*", "s.alike", "s.before")
    own = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("row"))
    again = joined.where("alike is not null").withColumn("number", own + F.col("before"))
    alone = joined.where("alike is null").withColumns({"alike": F.lit(1).cast("long"), "number": F.lit(1).cast("long")})
    return alone.unionByName(again).drop("part", "before")


def mixed(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """row, doc_id, source, size, source_size, target, copies and taken of each row of `docs` (doc_id, text, source).

    A document's share is its source's target over the source's size: that many copies, whole ones and a fraction that
    pivotal dependent rounding settles. Nodes of the reduction tree pair FAN documents of a source each, dealt by hash;
    what stays fractional at a node (one document at most) is paired again at the next level, up to one a source, which is
    drawn. So taken words (size * copies) differ from the target by less than the size of one document. A source that
    holds a third of all rows has more nodes, not larger ones. Rows of the same doc_id, source and size share their whole
    copies, and have one fraction together, so a node never fills with them. row is the row's number in the order of
    reading. Draws depend on doc_id, source and size alone: reruns agree, whatever the partitions.

    Null text: size 0, no copy. A source without words has target 0. Null source: the last source. Null doc_id: one id like
    any other. No rows: no rows. Other columns are ignored.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), sizes().alias("size"))
    table = written(slim)
    goals = written(targets(written(table.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))).drop("rows"), weights, share, most))
    most_rows = table.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    joined = table.alias("t").join(small(goals).alias("g"), F.col("t.source").eqNullSafe(F.col("g.source"))).select("row", "doc_id", "t.source", "size", "source_size", "target")
    rate = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(rate + NEAR).cast("int")
    draw = lambda level: F.xxhash64("doc_id", "source", "size", F.lit(f"{seed} {level}"))
    uniform = lambda level: F.shiftrightunsigned(draw(level), 11).cast("double") / float(1 << 53)
    start = numbered_alike(joined.withColumn("rate", rate).withColumn("whole", whole), ["doc_id", "source", "size"]).withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)) * F.col("alike"))
    more = F.floor(F.col("p") + NEAR)
    start = start.withColumns({"whole": F.col("whole") + (F.col("number") <= more).cast("int"), "p": F.when((F.col("number") == more + 1) & (F.col("p") - more > NEAR), F.col("p") - more).otherwise(0.0)})
    start = written(start.select("row", "doc_id", "source", "size", "source_size", "target", "whole", "p"))
    level, rows = 0, most_rows
    open_rows = start.where("p > 0").select("source", "row", "doc_id", "size", "p", "whole")
    settled = []
    while rows > 1:
        nodes = -(-rows // FAN)
        item = F.struct(draw(f"order {level}").alias("o"), uniform(f"pair {level}").alias("u"), *[F.col(c) for c in ("row", "doc_id", "size", "p", "whole")])
        node = open_rows.groupBy("source", F.pmod(draw(f"deal {level}"), F.lit(nodes)).alias("node")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        done = written(node.select("source", _round_group(F.col("items")).alias("r")).select("source", "r.done", "r.open"))
        settled.append(done.select("source", F.explode("done").alias("x")).select("x.row", (F.col("x.whole") + F.col("x.p").cast("int")).alias("copies")))
        open_rows = done.where("open is not null").select("source", "open.row", "open.doc_id", "open.size", "open.p", "open.whole")
        level, rows = level + 1, nodes if nodes > 1 else 1
    settled.append(open_rows.select("row", (F.col("whole") + (uniform("last") < F.col("p")).cast("int")).alias("copies")))
    decided = settled[0]
    for more in settled[1:]:
        decided = decided.unionByName(more)
    out = start.join(decided, "row", "left").withColumn("copies", F.coalesce("copies", F.col("whole")).cast("int"))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
