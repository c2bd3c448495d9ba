"""Parsing and normalising scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what counts as a dose, a separator or noise. (?U) makes \s and \d those of Unicode.
DOSE_SUFFIX = r"(?U)(?:\d++(?:\.\d++)?\s*+(?:g|G|克|mg|ml|ML)?+)++$"
PUNCTUATION = r"(?U)[\s.．。、,，;；:：\-—_/\\]+"
CODE_SEPARATOR = "[,，;；]"
CLAUSE_SEPARATOR = r"(?U)[，,。；;、\s]+"
CLAUSE_LEAD = "^(偶有|时有|自觉|诉|伴)"
CLAUSE_NEGATION = "^(无|未|不|否认)"
NEGATED = "无"
ITEM_SEPARATOR = r"(?U)[\s,，、;；]+"
LABEL_SEPARATOR = "[·/、|]"
LABEL_HEADER, ITEM_HEADER = "【中医诊断】", "【中药处方】"
DOSED = r"([一-鿿A-Za-z]+)\s*(\d+(?:\.\d+)?)?\s*(?:g|G|克)?"
SALT = "tidemark::"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def distinct_filled(parts: Column) -> Column:
    """Without empty strings, each kept where it comes first; null gives an empty array."""
    return F.coalesce(F.array_distinct(F.filter(parts, lambda p: p != "")), F.array().cast("array<string>"))


def normalize_item(c: Column, known: dict[str, str] | None = None, strict: bool = True) -> Column:
    """An item's name without its dose and punctuation. The dose goes before the punctuation, so a dose in front of a
    closing full stop stays, and `name_violation` finds it; strict=False strips the dose once more behind it."""
    out = F.regexp_replace(F.regexp_replace(strip(c), DOSE_SUFFIX, ""), PUNCTUATION, "")
    if not strict:
        out = F.regexp_replace(out, DOSE_SUFFIX, "")
    if known:
        out = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), out), out)
    return out


def name_violation(c: Column) -> Column:
    """Whether a normalised name still has ASCII letters or digits."""
    return c.rlike("[0-9A-Za-z]")


def clean_name(c: Column) -> Column:
    """A normalised name as it is; the query fails on one that still has ASCII letters or digits."""
    return F.when(name_violation(c), F.raise_error(F.concat(F.lit("unclean name: "), c))).otherwise(c)


def parse_items(c: Column) -> Column:
    return distinct_filled(F.transform(F.split(c, ","), lambda x: normalize_item(x)))


def parse_labels(c: Column, levels: tuple[str, ...] = ("disease", "pattern", "goal")) -> Column:
    """Comma-separated segments of exactly three levels, none empty; each kept where it comes first."""
    n = len(levels)
    segments = F.transform(F.split(c, ","), lambda s: F.transform(F.split(strip(s), "/"), strip))
    whole = F.filter(segments, lambda p: (F.size(p) == n) & F.forall(p, lambda x: x != ""))
    kind = "array<struct<" + ",".join(f"{x}:string" for x in levels) + ">>"
    return F.coalesce(F.array_distinct(F.transform(whole, lambda p: F.struct(*[p[i].alias(x) for i, x in enumerate(levels)]))), F.array().cast(kind))


def parse_codes(c: Column) -> Column:
    return distinct_filled(F.transform(F.split(c, CODE_SEPARATOR), strip))


def parse_age(c: Column) -> Column:
    """The first run of digits, null if there is none or it is no int."""
    return F.regexp_extract(c, r"\d+", 0).try_cast("int")


def hash_entity(c: Column, salt: str = SALT, prefix: str = "P") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 12))


def parse_date(c: Column) -> Column:
    """A date of year, month and day with - / or . between them; null if it isn't one."""
    plain = F.regexp_replace(strip(c), "[/.]", "-")
    parts = F.split(plain, "-")
    padded = F.concat_ws("-", F.get(parts, F.lit(0)), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.substring(F.get(parts, F.lit(2)), 1, 2), 2, "0"))
    return F.when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(padded))


def clauses(c: Column) -> Column:
    """The clauses of a text; a lead word goes, and a negation becomes NEGATED before the rest behind its first character."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), CLAUSE_SEPARATOR), lambda p: F.regexp_replace(p, CLAUSE_LEAD, "")), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike(CLAUSE_NEGATION), F.concat(F.lit(NEGATED), F.substr(p, F.lit(2)))).otherwise(p))


def redact(c: Column, pattern: str, placeholder: str) -> Column:
    return F.regexp_replace(c, pattern, placeholder)


def headed_parts(c: Column, first: str = LABEL_HEADER, second: str = ITEM_HEADER) -> tuple[Column, Column]:
    """The text behind the first header, and that behind the second; what headers are missing decides where each ends."""
    has_first, has_second = F.contains(c, F.lit(first)), F.contains(c, F.lit(second))
    after = F.substr(c, F.instr(c, F.lit(first)) + len(first))
    before_second = lambda x: F.substr(x, F.lit(1), F.instr(x, F.lit(second)) - 1)
    behind_second = lambda x: F.substr(x, F.instr(x, F.lit(second)) + len(second))
    split = F.contains(after, F.lit(second))
    labels = F.when(has_first, F.when(split, before_second(after)).otherwise(after)).when(has_second, before_second(c)).otherwise(c)
    items = F.when(has_first, F.when(split, behind_second(after)).otherwise("")).when(has_second, behind_second(c)).otherwise("")
    return labels, items


def parse_headed(c: Column) -> tuple[Column, Column]:
    """Labels and items of a text with headed parts: the inverse of `tidemark.functions.rendering.target`."""
    first, second = headed_parts(F.coalesce(c, F.lit("")))
    lines = F.transform(F.split(first, r"\R"), lambda x: F.regexp_replace(strip(x), "^[【】]+|[【】]+$", ""))
    kept = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("中医诊断")))
    parts = F.transform(kept, lambda x: F.filter(F.transform(F.split(x, LABEL_SEPARATOR), strip), lambda p: p != ""))
    some = F.filter(parts, lambda p: F.size(p).isin(2, 3))
    labels = F.array_distinct(F.transform(some, lambda p: F.struct(p[0].alias("disease"), p[1].alias("pattern"), F.coalesce(F.get(p, F.lit(2)), F.lit("")).alias("goal"))))
    items = distinct_filled(F.transform(F.split(second, ITEM_SEPARATOR), lambda x: normalize_item(x)))
    return labels, items


def parse_dosed(c: Column) -> Column:
    """item and dose (null without one) of each item in a free list."""
    names, doses = F.regexp_extract_all(c, F.lit(DOSED), 1), F.regexp_extract_all(c, F.lit(DOSED), 2)
    return F.transform(names, lambda x, i: F.struct(x.alias("item"), F.get(doses, i).try_cast("double").alias("dose")))


def split_goals(c: Column) -> Column:
    return distinct_filled(F.transform(F.split(c, r"(?U)[\s,，、;；]+"), strip))


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)<think>.*?</think>", "")


def estimate_tokens(c: Column, per_char: float = 0.8) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) * per_char)).cast("long")


def segment(c: Column, units: list[str]) -> Column:
    """At each place the longest unit that stands there; a character without one is skipped. No unit must have a regex character."""
    ordered = "|".join(sorted(units, key=lambda u: (-len(u), u)))
    return F.regexp_extract_all(c, F.lit(f"({ordered})"), 1)


def bigrams(c: Column) -> Column:
    return F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
