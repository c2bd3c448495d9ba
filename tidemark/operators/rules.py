"""A configurable rule checker for item lists: each check gives findings (rid, level, code, detail), and verdicts fold them.

Input rows have rid, items array<struct<item,dose>>, goals array<string> and restricted boolean. Checks are joins with small
rule tables or array functions; none shuffles the visits except by rid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sets import r6, safe_ratio
from tidemark.operators.broadcasts import small
from tidemark.operators.priors import literal

#: From harmless to forbidden; info ranks below a visit without findings.
LEVELS = ("info", "ok", "note", "warn", "block")


@dataclass(frozen=True)
class Rules:
    """Names, pairs and thresholds of the checks."""

    vocabulary: Sequence[str]
    pairs: Sequence[tuple[str, str]] = ()
    downgraded: Mapping[tuple[str, str], str] = field(default_factory=dict)
    forbidden: Sequence[str] = ()
    caution: Sequence[str] = ()
    caps: Mapping[str, float] = field(default_factory=dict)
    over: float = 1.5
    toxic: Sequence[str] = ()
    warn_below: float = 0.67
    note_below: float = 1.0
    opposing: Mapping[str, str] = field(default_factory=dict)
    low_confidence: float = 0.7


def coerce(raw: Column) -> Column:
    """Items of name and dose, from plain names."""
    return F.transform(raw, lambda x: F.struct(x.alias("item"), F.lit(None).cast("double").alias("dose")))


def names(c: Column | None = None) -> Column:
    return F.transform(F.col("items") if c is None else c, lambda x: x["item"])


def finding(rows: DataFrame, level: Column | str, code: Column | str, detail: Column) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select("rid", as_col(level).alias("level"), as_col(code).alias("code"), detail.alias("detail"))


def illegal(rows: DataFrame, rules: Rules) -> DataFrame:
    bad = F.array_except(names(), literal(rules.vocabulary))
    return finding(rows.where(F.size(bad) > 0), "block", "ILLEGAL_ITEM", F.array_join(F.sort_array(bad), ","))


def incompatible(rows: DataFrame, rules: Rules) -> DataFrame:
    """A finding for each unordered pair of the rules that a visit has."""
    pairs = F.array(*[F.struct(F.lit(min(p)).alias("a"), F.lit(max(p)).alias("b"), F.lit(rules.downgraded.get(tuple(sorted(p)), "block")).alias("level")) for p in rules.pairs])
    hit = rows.select("rid", names().alias("n")).withColumn("p", F.explode(F.filter(pairs, lambda p: F.array_contains(F.col("n"), p.a) & F.array_contains(F.col("n"), p.b))))
    return finding(hit, F.col("p.level"), "INCOMPATIBLE", F.concat_ws("+", "p.a", "p.b"))


def restricted(rows: DataFrame, rules: Rules) -> DataFrame:
    """Items that are forbidden, or need caution, for restricted entities alone."""
    out = []
    for level, code, listed in (("block", "RESTRICTED_FORBIDDEN", rules.forbidden), ("warn", "RESTRICTED_CAUTION", rules.caution)):
        bad = F.array_intersect(names(), literal(listed))
        out.append(finding(rows.where(F.col("restricted") & (F.size(bad) > 0)), level, code, F.array_join(F.sort_array(bad), ",")))
    return out[0].unionByName(out[1])


def doses(rows: DataFrame, rules: Rules, dictionary: DataFrame) -> DataFrame:
    """A dose above its absolute cap, or else above the dictionary's maximum times a factor."""
    each = rows.select("rid", F.explode("items").alias("x")).select("rid", "x.item", "x.dose").where("dose is not null")
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in rules.caps.items() for x in kv]), F.col("item")) if rules.caps else F.lit(None).cast("double")
    each = each.join(small(dictionary.select("item", "dose_max")), "item", "left").withColumn("cap", cap)
    code = F.when(F.col("dose") > F.col("cap"), "DOSE_CAP").when(F.col("dose") > F.col("dose_max") * rules.over, "DOSE_EXCEEDED")
    return finding(each.withColumn("code", code).where("code is not null"), F.when(F.col("code") == "DOSE_CAP", "block").otherwise("warn"), F.col("code"), F.col("item"))


def alerts(rows: DataFrame, rules: Rules) -> DataFrame:
    """rid and the items that need care in handling; they have no part in the verdict."""
    bad = F.array_intersect(names(), literal(rules.toxic))
    return rows.where(F.size(bad) > 0).select("rid", F.array_join(F.sort_array(bad), ",").alias("alerts"))


def covered(rows: DataFrame, dictionary: DataFrame, goal_map: DataFrame) -> DataFrame:
    """rid, goals, met (those that some item's capabilities meet) and capabilities, for visits with goals and capabilities."""
    from tidemark.operators.knowledge import visit_capabilities

    has = visit_capabilities(rows.select("rid", names().alias("items")), dictionary)
    goals = rows.select("rid", F.explode(F.array_distinct("goals")).alias("goal"))
    each = goals.join(has, "rid").join(small(goal_map.select("goal", "wanted")), "goal", "left")
    met = F.coalesce(F.arrays_overlap("capabilities", "wanted"), F.lit(False))
    return each.groupBy("rid").agg(F.sort_array(F.collect_list("goal")).alias("all_goals"), F.sort_array(F.collect_list(F.when(met, F.col("goal")))).alias("met"), F.first("capabilities").alias("capabilities"))


def coverage(rows: DataFrame, rules: Rules, dictionary: DataFrame, goal_map: DataFrame) -> DataFrame:
    """The share of goals that are met: none or less than a threshold warns, less than all is noted."""
    c = covered(rows, dictionary, goal_map).withColumn("share", safe_ratio(F.size("met"), F.size("all_goals")))
    code = F.when(F.col("share") == 0, "COVERAGE_ZERO").when(F.col("share") < rules.warn_below, "COVERAGE_LOW").when(F.col("share") < rules.note_below, "COVERAGE_PARTIAL")
    c = c.withColumn("code", code).where("code is not null")
    return finding(c, F.when(F.col("code") == "COVERAGE_PARTIAL", "note").otherwise("warn"), F.col("code"), F.array_join(F.array_except("all_goals", "met"), ","))


def contradiction(rows: DataFrame, rules: Rules, dictionary: DataFrame, goal_map: DataFrame) -> DataFrame:
    """A goal that isn't met while a capability that opposes it is there."""
    c = covered(rows, dictionary, goal_map)
    opposing = F.array(*[F.struct(F.lit(g).alias("goal"), F.lit(p).alias("pattern")) for g, p in rules.opposing.items()])
    open_goals = c.select("rid", "capabilities", F.explode(F.array_except("all_goals", "met")).alias("goal"))
    hit = open_goals.withColumn("p", F.explode(F.filter(opposing, lambda o: o.goal == F.col("goal"))))
    against = F.expr("filter(capabilities, c -> c rlike p.pattern)")
    return finding(hit.withColumn("against", against).where(F.size("against") > 0), "warn", "CONTRADICTION", F.concat("goal", F.lit(":"), F.array_join("against", ",")))


def confidence(rows: DataFrame, rules: Rules, dictionary: DataFrame) -> DataFrame:
    """Items without capabilities are told; a visit in which they are too many is noted."""
    known = dictionary.where(F.size("capabilities") > 0).select(F.col("item").alias("known"))
    each = rows.select("rid", F.explode(names()).alias("item")).join(small(known), F.col("item") == F.col("known"), "left")
    c = each.groupBy("rid").agg(F.avg(F.col("known").isNotNull().cast("int")).alias("share"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("item")))).alias("unknown"))
    a = finding(c.where(F.size("unknown") > 0), "info", "UNKNOWN_ITEM", F.array_join("unknown", ","))
    return a.unionByName(finding(c.where(F.col("share") < rules.low_confidence), "note", "LOW_CONFIDENCE", F.col("share").cast("decimal(6,4)").cast("string")))


def findings(rows: DataFrame, rules: Rules, dictionary: DataFrame, goal_map: DataFrame) -> DataFrame:
    """All checks together."""
    parts = [illegal(rows, rules), incompatible(rows, rules), restricted(rows, rules), doses(rows, rules, dictionary), coverage(rows, rules, dictionary, goal_map), contradiction(rows, rules, dictionary, goal_map), confidence(rows, rules, dictionary)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int")


def verdicts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rid, verdict (the highest level; ok at least), n_findings and codes, the most severe first."""
    marked = found.withColumn("rank", rank(F.col("level")))
    each = marked.groupBy("rid").agg(F.max("rank").alias("rank"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("m"), "code", "detail"))).alias("f"))
    verdict = F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(F.coalesce("rank", F.lit(2)), F.lit(2)))
    return rows.select("rid").join(each, "rid", "left").select("rid", verdict.alias("verdict"), F.coalesce("n", F.lit(0)).alias("n_findings"), F.coalesce(F.array_join(F.transform("f", lambda x: x.code), ","), F.lit("")).alias("codes"))


def negatives(rows: DataFrame, rules: Rules, dictionary: DataFrame, goals: Sequence[str]) -> DataFrame:
    """Rows with one planted violation each: case_type, expected codes, and the input of the checks. New ids are rid * 10 + case."""
    strong = dictionary.where(F.size("capabilities") > 0).agg(F.array_sort(F.collect_set("item")).alias("strong"))
    item = lambda name, dose=None: F.struct(F.lit(name).alias("item"), F.lit(dose).cast("double").alias("dose"))
    base = rows.crossJoin(F.broadcast(strong))
    a, b = sorted(rules.pairs[0])
    cap = sorted(rules.caps)[0]
    other = F.get(F.array_except(literal(goals), F.col("goals")), F.lit(0))
    cases = [
        ("swapped_goal", F.col("items"), F.array_compact(F.array(other)), F.col("restricted"), ("COVERAGE_ZERO", "CONTRADICTION")),
        ("stripped", F.expr("filter(items, x -> not array_contains(strong, x.item))"), F.col("goals"), F.col("restricted"), ("LOW_CONFIDENCE", "COVERAGE_ZERO", "COVERAGE_LOW")),
        ("pair", F.concat(F.expr(f"filter(items, x -> x.item not in ('{a}', '{b}'))"), F.array(item(a), item(b))), F.col("goals"), F.col("restricted"), ("INCOMPATIBLE",)),
        ("illegal", F.concat("items", F.array(item("No such item"))), F.col("goals"), F.col("restricted"), ("ILLEGAL_ITEM",)),
        ("restricted", F.concat("items", F.array(item(rules.forbidden[0]))), F.col("goals"), F.lit(True), ("RESTRICTED_FORBIDDEN",)),
        ("dose", F.concat("items", F.array(item(cap, rules.caps[cap] * 10))), F.col("goals"), F.col("restricted"), ("DOSE_CAP",)),
    ]
    out = None
    for k, (name, items, wanted, flag, codes) in enumerate(cases):
        one = base.select((F.col("rid") * 10 + k).alias("rid"), items.alias("items"), wanted.alias("goals"), flag.alias("restricted"), F.lit(name).alias("case_type"), literal(codes).alias("expected"))
        out = one if out is None else out.unionByName(one)
    return out


def detection(cases: DataFrame, found: DataFrame) -> DataFrame:
    """case_type, n and the share of cases with one of the expected codes."""
    got = found.groupBy("rid").agg(F.collect_set("code").alias("got"))
    hit = F.coalesce(F.arrays_overlap("got", "expected"), F.lit(False))
    return cases.join(got, "rid", "left").groupBy("case_type").agg(F.count("*").alias("n"), r6(F.avg(hit.cast("int"))).alias("detected"))


def dose_for(toxic: Sequence[str]) -> Column:
    """The dose of an item with dose_min and dose_max: the least of a toxic one, else the rounded middle (half to even) within the range; null without a range."""
    middle = F.least(F.greatest(F.bround((F.col("dose_min") + F.col("dose_max")) / 2, 0), F.col("dose_min")), F.col("dose_max"))
    return F.when(F.col("dose_min").isNull() | F.col("dose_max").isNull(), F.lit(None)).when(F.col("item").isin(*toxic), F.col("dose_min")).otherwise(middle)


def fill_doses(rows: DataFrame, dictionary: DataFrame, toxic: Sequence[str]) -> DataFrame:
    """rid, n, n_filled, total and any_toxic of the distinct items' doses."""
    each = rows.select("rid", F.explode(F.array_distinct("items")).alias("item")).join(small(dictionary.select("item", "dose_min", "dose_max")), "item", "left").withColumn("dose", dose_for(toxic))
    return each.groupBy("rid").agg(F.count("*").alias("n"), F.count("dose").alias("n_filled"), F.round(F.coalesce(F.sum("dose"), F.lit(0.0)), 4).alias("total"), F.bool_or(F.col("item").isin(*toxic)).alias("any_toxic"))


def validated(items: Column, rules: Rules, rounds: int = 3) -> Column:
    """A struct of items, attempts and failed: lists are checked for incompatible pairs that block, the later item of each is banned, and what is left is checked again, `rounds` times at most."""
    pairs = [(a, b) for a, b in rules.pairs if rules.downgraded.get(tuple(sorted((a, b))), "block") == "block"]
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]) if pairs else F.expr("cast(array() as array<struct<a:string,b:string>>)")

    def banned(h: Column) -> Column:
        both = F.filter(known, lambda p: F.array_contains(h, p.a) & F.array_contains(h, p.b))
        return F.transform(both, lambda p: F.when(F.array_position(h, p.a) > F.array_position(h, p.b), p.a).otherwise(p.b))

    def again(s: Column, _: Column) -> Column:
        out = banned(s["items"])
        left = F.filter(s["items"], lambda x: ~F.array_contains(out, x))
        more = F.size(out) > 0
        return F.struct(left.alias("items"), (s.attempts + more.cast("int")).alias("attempts"))

    start = F.struct(items.alias("items"), F.lit(1).alias("attempts"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again, lambda s: F.struct(s["items"].alias("items"), s.attempts.alias("attempts"), (F.size(banned(s["items"])) > 0).alias("failed")))


def repair(items: Column, rules: Rules) -> Column:
    """Items without the illegal ones, and without the later one of each incompatible pair, pair after pair."""
    out = F.filter(items, lambda x: x.isin(*rules.vocabulary))
    for a, b in rules.pairs:
        both = F.array_contains(out, a) & F.array_contains(out, b)
        later = F.when(F.array_position(out, a) > F.array_position(out, b), F.lit(a)).otherwise(F.lit(b))
        out = F.when(both, F.array_remove(out, later)).otherwise(out)
    return out


def schema(vocabulary: Sequence[str], least: int = 1, most: int = 40, name: str = "items") -> dict:
    """The JSON schema of an object with a list of distinct items of the vocabulary."""
    listed = {"type": "array", "items": {"type": "string", "enum": sorted(vocabulary)}, "minItems": least, "maxItems": most, "uniqueItems": True}
    return {"type": "object", "properties": {name: listed}, "required": [name], "additionalProperties": False}


def fits_schema(items: Column, wanted: dict) -> Column:
    """Whether a list is what `schema` asks for."""
    (listed,) = wanted["properties"].values()
    size = F.size(items)
    return (size >= listed["minItems"]) & (size <= listed["maxItems"]) & (F.size(F.array_distinct(items)) == size) & (F.size(F.array_except(items, literal(listed["items"]["enum"]))) == 0)


def grammar_check(vocabulary: Sequence[str], separator: str = " ") -> dict:
    """Whether the pattern takes each item and a list of some, and refuses a list with another name."""
    import re

    pattern = re.compile(grammar(vocabulary, separator))
    stranger = "".join(vocabulary) + "?"
    return {
        "items": len(vocabulary), "single": sum(bool(pattern.match(v)) for v in vocabulary), "several": bool(pattern.match(separator.join(vocabulary[:5]))),
        "refuses": not pattern.match(separator.join([*vocabulary[:2], stranger])), "length": len(pattern.pattern),
    }


def rendered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rid and text: the verdict and how many findings there are, then a line for each finding, the most severe first."""
    lines = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct((-rank(F.col("level"))).alias("m"), "code", "detail", "level"))).alias("f"))
    each = F.transform("f", lambda x: F.concat(F.lit("- ["), x.level, F.lit("] "), x.code, F.lit(": "), x.detail))
    head = F.concat(F.col("verdict"), F.lit(" ("), F.col("n_findings").cast("string"), F.lit(")"))
    return verdicts(rows, found).join(lines, "rid", "left").select("rid", F.concat_ws("\n", head, each).alias("text"))


def grammar(vocabulary: Sequence[str], separator: str = " ") -> str:
    """The pattern of item lists: names of the vocabulary, one separator between them."""
    import re

    one = "|".join(re.escape(v) for v in sorted(vocabulary, key=lambda v: (-len(v), v)))
    return f"^({one})({re.escape(separator)}({one}))*$"
