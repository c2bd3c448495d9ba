"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions alone (operator 3)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small, written

#: Words are runs of other characters than these.
GAP = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(hashes: Column, size: int) -> Column:
    """How many words lie in a window of `size` words whose hash occurs twice or more among `hashes`, which are in the windows' order."""
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda e, i: (e.h == F.get(s, i - 1).h) | (e.h == F.get(s, i + 1).h))
        places = F.sort_array(F.transform(again, lambda e: e.i))
        start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a.n + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")), lambda a: a.n)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(marked, covered))


def statistics(docs: DataFrame, window: int = 3) -> DataFrame:
    """Adds STATS (long) to `docs`, from each whole text (column text, which it drops).

    n_words words; word_chars code points in words; n_symbols characters of SYMBOLS; n_dup_lines lines with a word that
    equal an earlier line; n_repeat_words words in windows of `window` words that the text holds twice or more, told by
    64-bit hashes of their words. Each text is worked on by itself, so nothing is shuffled. Null text: zeros.
    """
    text = F.coalesce("text", F.lit(""))
    others = [c for c in docs.columns if c != "text"]
    first = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(f"([^{GAP}]+)"), 1))
    n = F.size("_words")
    windows = F.slice("_words", 1, F.greatest(n - (window - 1), F.lit(0)))
    hashes = F.transform(windows, lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, window)]))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{GAP}]"))
    bare = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    second = first.select(
        *others, n.cast("long").alias("n_words"), bare.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), hashes.alias("_hashes"),
    )
    return second.withColumn("n_repeat_words", repeated_words(F.col("_hashes"), window).cast("long")).drop("_hashes")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: The transformed statistics, and the resolution of each (added to the estimate as a spread): word lengths are told apart to
#: one part in twenty, and one event more or less in 100 words is no sign of anything.
EVENT = math.log(2)
VECTOR = (
    ("x1", "ln(greatest(word_chars, 1) / greatest(n_words, 1))", 0.05),
    ("x2", "ln(1 + 100 * n_symbols / greatest(n_words, 1))", EVENT),
    ("x3", "ln(1 + 100 * n_repeat_words / greatest(n_words, 1))", EVENT),
    ("x4", "ln(1 + 100 * n_dup_lines / greatest(n_words, 1))", EVENT),
)
#: Rows that a group needs for an estimate of its own, the share of a normal distribution that is kept, and by what the
#: logarithm of a determinant falls at least in a step that isn't the last.
LEAST_ROWS, KEPT, FALL = 2 * (len(VECTOR) + 1), 0.999, 1e-3
#: Distances are counted in steps of 1 / FINE of their logarithm.
FINE = 64
#: Files of a table with a row a group.
FILES = 4


def _chi(x: float) -> float:
    """Distribution function of chi-square with 4 degrees of freedom."""
    return 1 - math.exp(-x / 2) * (1 + x / 2)


def quantile(share: float) -> float:
    """The squared Mahalanobis distance within which a 4-dimensional normal distribution has so much."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        lo, hi = ((lo + hi) / 2, hi) if _chi((lo + hi) / 2) < share else (lo, (lo + hi) / 2)
    return lo


def consistency(share: float) -> float:
    """By what the covariance of the nearest `share` of a normal distribution in 4 dimensions is multiplied to be that of all."""
    x = quantile(share)
    return share / (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8))


_X = [name for name, _, _ in VECTOR]
_D = range(len(_X))


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)], *[F.covar_pop(_X[i], _X[j]).alias(f"c{i}{j}") for i in _D for j in range(i + 1)]]


def _factored(table: DataFrame, keys: list[str], factor: float | Column) -> DataFrame:
    """From moments m, c: the inverse Cholesky factor w (w00, w10, ...) of factor * c plus the least spreads, and the logarithm of its determinant."""
    out = table.select(*keys, "n", *[f"m{i}" for i in _D], *[(F.col(f"c{i}{j}") * factor + (VECTOR[i][2] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in _D for j in range(i + 1)])
    for j in _D:  # lower triangle, column by column
        for i in range(j, len(_X)):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for j in _D:  # inverse of the triangle
        for i in range(j, len(_X)):
            rest = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            out = out.withColumn(f"w{i}{j}", rest / F.col(f"l{i}{i}"))
    det = sum((F.ln(f"l{i}{i}") for i in _D), F.lit(0.0)) * 2
    return out.select(*keys, "n", *[f"m{i}" for i in _D], *[f"w{i}{j}" for i in _D for j in range(i + 1)], det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of x from m by w."""
    total = F.lit(0.0)
    for i in _D:
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col(f"w{i}{j}") * (F.col(_X[j]) - F.col(f"m{j}"))
        total = total + part * part
    return total


def estimates(table: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group of `table` (group, x1..x4): group, m, w.

    Two starts, one from medians and quartiles and one from mean and covariance, are concentrated: the rows nearest to
    an estimate, just over half of the group, give the next one, until the determinant stops falling. The one with the least
    determinant stays. A step is one aggregation: all rows are summed by group and step of distance (FINE), and the sums of the
    nearest steps that hold (rows + dimensions + 1) / 2 rows are the next subset. Groups that have converged are left out.
    """
    quartiles = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i, x in enumerate(_X)]
    raw = written(table.groupBy("group").agg(*_moments(), *quartiles).coalesce(FILES))
    robust = raw.select("group", F.lit(0).alias("start"), "n", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in _D], *[(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in _D for j in range(i + 1)])
    plain = raw.select("group", F.lit(1).alias("start"), "n", *[f"m{i}" for i in _D], *[f"c{i}{j}" for i in _D for j in range(i + 1)])
    keys = ["group", "start"]
    active = written(_factored(robust.unionByName(plain), keys, 1.0).withColumn("log_det", F.lit(float("inf"))))
    factors = F.array(*[F.lit(consistency(k / 1000)) for k in range(500, 1001)])
    pairs = [(i, j) for i in _D for j in range(i + 1)]
    sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(_X)], *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}{j}") for i, j in pairs]]
    nearer = Window.partitionBy(*keys).orderBy("step")
    steps: list[DataFrame] = []
    while not active.isEmpty():
        far = table.join(small(active.drop("n")), "group").withColumn("step", F.floor(F.ln(F.greatest(_distance(), F.lit(1e-12))) * FINE))
        held = far.groupBy(*keys, "step").agg(*sums, F.first("log_det").alias("before"))
        upto = held.select(*keys, "before", F.sum("n").over(Window.partitionBy(*keys)).alias("rows"), *[F.sum(c).over(nearer).alias(c) for c in ("n", *[f"s{i}" for i in _D], *[f"s{i}{j}" for i, j in pairs])])
        enough = upto.where(2 * F.col("n") >= F.col("rows") + len(_X) + 1).groupBy(*keys).agg(F.min_by(F.struct(*[c for c in upto.columns if c not in keys]), "n").alias("u")).select(*keys, "u.*")
        moments = enough.select(*keys, "n", "rows", "before", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in _D], *[(F.col(f"s{i}{j}") / F.col("n") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n") / F.col("n")).alias(f"c{i}{j}") for i, j in pairs])
        share = F.greatest(F.round(1000 * F.col("n") / F.col("rows")).cast("int") - 500, F.lit(0))
        steps.append(written(_factored(moments, [*keys, "before"], F.get(factors, share)).coalesce(FILES)))
        active = steps[-1].where(F.col("log_det") < F.col("before") - FALL).drop("before")
    if not steps:
        return active.select("group", *[c for c in active.columns if c[0] in "mw"])
    found = [c for c in steps[0].columns if c[0] in "mw"]
    every = steps[0].withColumn("turn", F.lit(0))
    for k, more in enumerate(steps[1:], 1):
        every = every.unionByName(more.withColumn("turn", F.lit(k)))
    return every.groupBy("group").agg(F.min_by(F.struct(*found), F.struct("log_det", "turn", "start")).alias("e")).select("group", "e.*")


def _group(level: int) -> Column:
    """The key of a row's group: by language and source, by language, and all rows."""
    own = (F.struct("lang", "source"), F.struct("lang"), None)[level]
    return F.lit("all") if own is None else F.concat(F.lit(f"{level}:"), F.to_json(own))


def judged(docs: DataFrame, carry: list[str], least_rows: int = LEAST_ROWS, kept: float = KEPT) -> DataFrame:
    """Judges each row of `docs` (doc_id, text, lang, source): a struct doc of the columns `carry`, STATS, base_failed, distance, kept.

    base_failed: fewer than 50 words, or over half of them in repeated windows. The other rows are rejected where the
    vector of transformed statistics (VECTOR) is farther from the robust centre of its language and source than the share
    `kept` of a normal distribution reaches (a quantile of chi-square). A group of fewer than `least_rows` rows, too few for
    the estimate, is judged by that of its language, or of all rows; with fewer in all, none is rejected.
    distance (squared) is null for rows that base rules reject.

    Null language and source are groups of their own; null text counts as empty. Equal statistics: no spread but the
    resolution, so nothing divides by zero. Null doc_id and repeated rows: judged like any other. No rows: no rows. What is
    carried is written once beside the statistics, so that texts aren't shuffled and are split into words once.
    """
    stats = statistics(docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), "text", "lang", "source"))
    table = written(stats.withColumn("base_failed", base_failed()).withColumns({x: F.expr(e) for x, e, _ in VECTOR}))
    fair = table.where(~F.col("base_failed"))
    levels = [_group(k).alias(f"g{k}") for k in range(3)]
    sizes = written(fair.select(*levels).groupBy("g0", "g1", "g2").agg(F.count("*").alias("n0")))
    total = sizes.agg(F.sum("n0")).first()[0] or 0
    by_language = sizes.groupBy("g1").agg(F.sum("n0").alias("n1"))
    own = F.when(F.col("n0") >= least_rows, F.col("g0")).when(F.col("n1") >= least_rows, F.col("g1")).when(F.lit(total >= least_rows), F.col("g2"))
    choice = written(sizes.join(by_language, "g1").select(F.col("g0").alias("own"), own.alias("group")).where("group is not null"))
    grouped = fair.select(F.explode(F.array(*levels)).alias("group"), *_X).join(small(choice.select("group").distinct()), "group")
    found = estimates(written(grouped))
    chosen = small(written(choice.join(found, "group").drop("group")))
    distance = F.when(~F.col("base_failed"), _distance())
    out = table.withColumn("own", _group(0)).join(chosen, "own", "left").withColumn("distance", distance)
    stays = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= quantile(kept))
    return out.select("doc", *STATS, "base_failed", "distance", stays.alias("kept"))
