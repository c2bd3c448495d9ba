"""Resolving names against a knowledge base, and what goals its entries can meet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import bigrams, segment
from tidemark.functions.sets import r6
from tidemark.operators.broadcasts import small


def expansions(name: Column, patterns: Sequence[str], rounds: int = 3) -> Column:
    """A name and what is left of it when patterns are taken off, breadth first over some rounds; each where it comes first."""
    out = F.array(name)
    for _ in range(rounds):
        new = F.flatten(F.transform(out, lambda c: F.array(*[F.regexp_replace(c, p, "") for p in patterns])))
        out = F.array_distinct(F.concat(out, F.filter(new, lambda c: c != "")))
    return out


def resolve(names: DataFrame, known: DataFrame, patterns: Sequence[str], rounds: int = 3) -> DataFrame:
    """name, target, tier and step: the first expansion of a name that is known, and of its entries that of the lowest tier.

    known: alias, target, tier (0 first). Names without an entry keep a null target.
    """
    each = names.select("name", F.posexplode(expansions(F.col("name"), patterns, rounds)).alias("step", "alias"))
    lookup = known.groupBy("alias").agg(F.min(F.struct("tier", "target")).alias("k"))
    hit = each.join(small(lookup), "alias").groupBy("name").agg(F.min(F.struct("step", "k.tier", "k.target")).alias("h"))
    return names.select("name").distinct().join(hit, "name", "left").select("name", "h.target", "h.tier", "h.step")


def strip_name(name: Column, patterns: Sequence[str], known: Mapping[str, str], rounds: int = 3) -> Column:
    """The known name of an item: itself, or after up to some rounds of taking the patterns off in turn; else unchanged."""
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    tries, c = [F.element_at(lookup, name)], name
    for _ in range(rounds):
        for p in patterns:
            c = F.regexp_replace(c, p, "")
        tries.append(F.element_at(lookup, c))
    return F.coalesce(*tries, name)


def first_with(name: Column, patterns: Sequence[str], good: Mapping[str, str], times: int = 9) -> Column:
    """The first entry with content that is reached by taking the patterns off again and again."""
    return F.nullif(strip_name(name, patterns, good, times), name)


def unit_capabilities(units: DataFrame, capabilities: DataFrame) -> DataFrame:
    """unit and its capabilities: those of the vocabulary that match its pattern. units: unit, pattern. Both tables are lists of words."""
    return F.broadcast(units).join(capabilities, F.expr("capability rlike pattern")).groupBy("unit").agg(F.sort_array(F.collect_set("capability")).alias("capabilities"))


def goal_rules(goals: DataFrame, units: Sequence[str], by_unit: DataFrame) -> DataFrame:
    """goal and the union of its units' capabilities."""
    parts = goals.select("goal", F.explode_outer(segment(F.col("goal"), list(units))).alias("unit"))
    flat = by_unit.select("unit", F.explode("capabilities").alias("capability"))
    return parts.join(small(flat), "unit", "left").groupBy("goal").agg(F.sort_array(F.collect_set("capability")).alias("capabilities"))


def bigram_hit(goal: Column, text: Column) -> Column:
    return F.exists(bigrams(goal), lambda g: F.contains(text, g))


def visit_capabilities(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rid and the distinct capabilities of a visit's items; visits without any are left out."""
    items = rows.select("rid", F.explode("items").alias("item"))
    own = dictionary.select("item", F.explode("capabilities").alias("capability"))
    return items.join(small(own), "item").groupBy("rid").agg(F.sort_array(F.collect_set("capability")).alias("capabilities"))


def goal_coverage(goals: DataFrame, has: DataFrame, goal_map: DataFrame) -> DataFrame:
    """rid, goal and whether the visit's capabilities meet it. goals: rid, goal; has: rid, capabilities; goal_map: goal, wanted."""
    return goals.join(has, "rid").join(small(goal_map), "goal", "left").select("rid", "goal", F.coalesce(F.arrays_overlap("capabilities", "wanted"), F.lit(False)).alias("covered"))


def mined_capabilities(goals: DataFrame, has: DataFrame, least: int, share: float, lift: float, n: int) -> DataFrame:
    """goal, capability, visits, share and lift: up to n capabilities of each goal that its visits have more often than others."""
    rows = goals.select("rid", "goal").distinct().join(has, "rid")
    total = has.agg(F.count("*").alias("total"))
    base = has.select(F.explode("capabilities").alias("capability")).groupBy("capability").agg(F.count("*").alias("n_cap"))
    per_goal = rows.groupBy("goal").agg(F.count("*").alias("n_goal")).where(F.col("n_goal") >= least)
    both = rows.select("goal", F.explode("capabilities").alias("capability")).groupBy("goal", "capability").agg(F.count("*").alias("visits"))
    scored = both.join(small(per_goal), "goal").join(small(base), "capability").crossJoin(F.broadcast(total)).withColumn("share", F.col("visits") / F.col("n_goal"))
    scored = scored.withColumn("lift", F.round(F.col("share") / (F.col("n_cap") / F.col("total")), 9)).where((F.col("share") >= share) & (F.col("lift") >= lift))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("lift"), "capability"))).where(F.col("r") <= n)
    return top.select("goal", "capability", "visits", r6(F.col("share")).alias("share"), r6(F.col("lift")).alias("lift"))


def merged_map(rules: DataFrame, mined: DataFrame, lift: float) -> DataFrame:
    """goal, capability and source: those of the rules, and the mined ones with enough lift that the rules lack."""
    a = rules.select("goal", F.explode("capabilities").alias("capability"), F.lit("rule").alias("source"))
    b = mined.where(F.col("lift") >= lift).select("goal", "capability", F.lit("data").alias("source"))
    return a.unionByName(b.join(small(a.select("goal", "capability")), ["goal", "capability"], "left_anti"))


def merged_dictionary(names: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """One entry for each name (name, target): fields of the first source, or else the second, and a stub where neither has it.

    first, second: target, category, dose_min, dose_max.
    """
    fields = ["category", "dose_min", "dose_max"]
    a, b = (small(t.select(F.col("target").alias(f"_t{i}"), *[F.col(c).alias(f"_{c}{i}") for c in fields])) for i, t in enumerate((first, second)))
    joined = names.join(a, F.col("target") == F.col("_t0"), "left").join(b, F.col("target") == F.col("_t1"), "left")
    source = F.when(F.col("_t0").isNotNull() & F.col("_t1").isNotNull(), "both").when(F.col("_t0").isNotNull(), "first").when(F.col("_t1").isNotNull(), "second").otherwise("unmapped")
    return joined.select("name", "target", source.alias("source"), *[F.coalesce(f"_{c}0", f"_{c}1").alias(c) for c in fields])


def named_composition(formulas: DataFrame, names: DataFrame) -> DataFrame:
    """Formulas with the names behind their composition's keys, in order. formulas: formula, composition array<struct<key,role>>; names: key, name."""
    flat = formulas.select("formula", F.posexplode("composition").alias("pos", "c")).select("formula", "pos", "c.key", "c.role")
    out = flat.join(small(names), "key", "left")
    return out.groupBy("formula").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("name", "key").alias("name"), "role"))), lambda x: F.struct(x["name"].alias("name"), x["role"].alias("role"))).alias("composition"))
