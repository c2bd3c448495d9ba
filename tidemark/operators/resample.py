"""Bootstrap and permutation tests whose draws are hashes, so that they can be repeated anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sets import r6
from tidemark.operators.broadcasts import held
from tidemark.operators.checks import pick_by_index
from tidemark.operators.splits import order_hash


#: Draws that one hash gives, each as 8 hexadecimal digits.
DRAWS = 8


def poisson_bounds(most: int = 12) -> list[str]:
    """The least 8-digit hexadecimal draws that count 1, 2, ... times: cumulative probabilities of a Poisson distribution with mean 1."""
    return [f"{min(2**32 - 1, round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))):08x}" for k in range(most)]


def poisson(digits: Column) -> Column:
    """How often a row counts whose draw has these digits; most rows are decided by the first comparisons."""
    bounds = poisson_bounds()
    count = F.when(digits < bounds[0], 0)
    for k, bound in enumerate(bounds[1:], 1):
        count = count.when(digits < bound, k)
    return count.otherwise(len(bounds))


def draw(*parts) -> Column:
    """A uniform whole number below 2^32 from the hash of columns and constants."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *cols), 256), 1, 8), 16, 10).cast("long")


def bootstrap_means(rows: DataFrame, key: str, value: str, times: int, seed=7) -> DataFrame:
    """b and the mean of `value` in each of `times` resamples, in which a row counts as often as a Poisson draw of its own says.

    One pass without a join: each row's hashes give DRAWS counts each, and tasks sum them before anything is shuffled.
    """
    hashed = rows.select(F.col(key).alias("_key"), F.col(value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(-(-times // DRAWS) - 1))).alias("g"))
    hashed = hashed.select("g", "v", F.sha2(F.concat_ws(":", F.col("_key").cast("string"), "g", F.lit(str(seed))), 256).alias("h"))
    counts = hashed.select("g", "v", *[poisson(F.substring("h", 8 * j + 1, 8)).alias(f"c{j}") for j in range(DRAWS)])
    sums = counts.groupBy("g").agg(*[F.struct(F.sum(F.col(f"c{j}") * F.col("v")).alias("s"), F.sum(f"c{j}").alias("n")).alias(f"d{j}") for j in range(DRAWS)])
    each = sums.select("g", F.posexplode(F.array(*[f"d{j}" for j in range(DRAWS)])).alias("j", "d"))
    return each.select((F.col("g") * DRAWS + F.col("j")).cast("long").alias("b"), F.round(F.try_divide("d.s", "d.n"), 9).alias("mean")).where(F.col("b") < times)


def interval(means: DataFrame, times: int, alpha: float = 0.05) -> DataFrame:
    """low and high: the means at places int(times * alpha / 2) and int(times * (1 - alpha / 2))."""
    places = {"low": F.lit(int(times * alpha / 2)), "high": F.lit(min(times - 1, int(times * (1 - alpha / 2))))}
    return pick_by_index(means.select("mean"), [], "mean", places).select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


def bootstrap_ci(rows: DataFrame, key: str, value: str, times: int = 1000, alpha: float = 0.05, seed=7) -> DataFrame:
    return _around(rows, value, bootstrap_means(rows, key, value, times, seed), times, alpha)


def _around(rows: DataFrame, value: str, means: DataFrame, times: int, alpha: float) -> DataFrame:
    total = rows.agg(F.count("*").alias("n"), r6(F.avg(value)).alias("mean"))
    return total.crossJoin(F.broadcast(interval(means, times, alpha)))


def paired_bootstrap(rows: DataFrame, key: str, a: str, b: str, times: int = 1000, seed=7) -> DataFrame:
    """The mean difference a - b, its 95 % interval, and p, the share of resampled means that aren't above 0."""
    diff = held(rows.select(key, (F.col(a) - F.col(b)).alias("d")))
    means = held(bootstrap_means(diff, key, "d", times, seed))
    out = _around(diff, "d", means, times, 0.05)
    return out.crossJoin(F.broadcast(means.agg(r6(F.avg((F.col("mean") <= 0).cast("int"))).alias("p"))))


def item_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.select(*by, F.explode("items").alias("item")).groupBy(*by, "item").agg(F.count("*").alias("n"))


def top_set(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    """The set of the k most frequent items of each group. counts: the columns of `by`, item, n."""
    ordered = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("item").alias("item")))).alias("all"))
    return ordered.select(*by, F.transform(F.slice("all", 1, k), lambda x: x["item"]).alias("top"))


def band(n: int, size: int, width: float) -> tuple[str, str]:
    """Hexadecimal bounds between which the n-th least of `size` hashes lies, but for `width` standard deviations."""
    share, one = n / max(size, 1), 16**12
    reach = width * (math.sqrt(share * (1 - share) / max(size, 1)) + 1 / max(size, 1))
    low, high = int(max(0.0, share - reach) * one), math.ceil((share + reach) * one)
    return f"{low:012x}", "g" if high >= one else f"{high:012x}"


def split_counts(base: DataFrame, times: int, n: int, size: int, width: float = 6) -> DataFrame:
    """b, item and n: how many of the first `n` rows of split b have the item. Split b orders the `size` rows of `base`
    (rid, items) by a hash of rid and b.

    Rows aren't sorted: tasks count the items of those whose hash lies below the band in which the n-th must be, and pass on
    only the rows of the band, whose number grows with the root of the input. Those are ranked. If the n-th row of a split isn't in
    the band, all is done again with a wider one.
    """
    key = F.concat_ws(":", "rid", "b")
    keyed = base.select("rid", "items", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).alias("b")).withColumn("_key", key)
    hashed = keyed.select("rid", "items", "b", order_hash("_key", seed="perm").alias("h"))
    while True:
        low, high = band(n, size, width)
        below = F.col("h") < low
        each = hashed.where(F.col("h") < high).select("b", F.when(~below, F.struct("rid", "items")).alias("edge"), F.posexplode_outer(F.when(below, F.col("items"))).alias("pos", "item"))
        counts = each.groupBy("b", "edge", "item", F.col("pos").isNotNull().alias("some")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows"))
        counts = held(counts)
        sizes = held(counts.groupBy("b").agg(F.sum(F.when(F.col("edge").isNull(), F.col("rows")).otherwise(0)).alias("below"), F.sum("rows").alias("reached")))
        if not n or sizes.where((F.col("below") <= n) & (F.col("reached") >= n)).count() == times:
            break
        counts.unpersist(), sizes.unpersist()
        width *= 8
    edge = counts.where("edge is not null").select("b", "edge.*", F.explode(F.sequence(F.lit(1), "rows"))).join(F.broadcast(sizes), "b").withColumn("_key", key)
    rank = F.row_number().over(Window.partitionBy("b").orderBy(order_hash("_key", seed="perm"), "_key"))
    rest = edge.withColumn("_rank", rank).where(F.col("_rank") <= n - F.col("below"))
    found = counts.where("edge is null and some").select("b", "item", "n").unionByName(item_counts(rest, ["b"]))
    return found.groupBy("b", "item").agg(F.sum("n").alias("n"))


def style_effect(rows: DataFrame, marked: Column, k: int, times: int) -> DataFrame:
    """Whether items differ between rows with and without a marker: the Jaccard index of their k most frequent items, and p,
    the share of random splits of the same sizes whose index is no larger; p_corrected adds the observed split to both.

    rows: rid, items. A split is the first rows in the order of a hash; groups are items, so collected lists are vocabularies.
    Items are counted on the marked side alone; the other side has the rest of all.
    """
    from tidemark.functions.sets import jaccard

    base = held(rows.select("rid", "items", marked.alias("m")))
    n, size = base.agg(F.count_if("m"), F.count("*")).first()
    observed = item_counts(base.select(F.lit(-1).cast("long").alias("b"), "m", "items"), ["b", "m"])
    first = split_counts(base.select("rid", "items"), times, n, size).select(F.col("b").alias("_b"), F.col("item").alias("_item"), F.col("n").alias("n1"))
    whole = item_counts(base, []).crossJoin(F.broadcast(base.sparkSession.range(times).select(F.col("id").alias("b"))))
    both = whole.join(first, (F.col("b") == F.col("_b")) & F.col("item").eqNullSafe(F.col("_item")), "left").withColumn("n1", F.coalesce("n1", F.lit(0)))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("m"), F.col("n1").alias("n")), F.struct(F.lit(False).alias("m"), (F.col("n") - F.col("n1")).alias("n"))))
    every = observed.unionByName(both.select("b", "item", sides.alias("s")).select("b", "item", "s.*").where("n > 0"))
    tops = top_set(every, ["b", "m"], k).groupBy("b").agg(F.max(F.when(F.col("m"), F.col("top"))).alias("x"), F.max(F.when(~F.col("m"), F.col("top"))).alias("y"))
    j = tops.select("b", F.round(F.coalesce(jaccard(F.col("x"), F.col("y")), F.lit(0.0)), 9).alias("j"))
    seen = j.where("b = -1").select(F.col("j").alias("observed"))
    return j.where("b >= 0").crossJoin(F.broadcast(seen)).groupBy("observed").agg(
        F.lit(n).alias("marked"), r6(F.avg("j")).alias("expected"), r6(F.avg((F.col("j") <= F.col("observed")).cast("int"))).alias("p"),
        r6((F.count_if(F.col("j") <= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_corrected"),
    ).select(r6(F.col("observed")).alias("observed"), "marked", "expected", "p", "p_corrected")


