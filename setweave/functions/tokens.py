"""Token vocabulary rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points at which a graded family reaches its levels; most points of a set; points of a main and a sub slot.
LADDER = (3, 6, 12, 15, 21, 29, 38, 51, 57)
TOTAL, MAIN, SUB, SUB_SLOTS = 57, 10, 3, 9
NULL, PAD, MASK = "<NULL>", "<PAD>", "<MASK>"


def ladder(levels: tuple[int, ...] = LADDER) -> Column:
    return F.array(*map(F.lit, levels))


def level_of(ap: Column, levels: tuple[int, ...] = LADDER) -> Column:
    """Highest level that ap points reach; null under the lowest."""
    return F.array_max(F.filter(ladder(levels), lambda t: t <= ap))


def graded_tags(family: Column, points: Column, levels: tuple[int, ...] = LADDER) -> Column:
    """family_level for each level that points reach."""
    return F.transform(F.filter(ladder(levels), lambda t: t <= points), lambda t: F.concat_ws("_", family, t))


def cumulative_tags(ap: Column, order: list[str], binary: list[str] = [], levels: tuple[int, ...] = LADDER, keep_zero_binary: bool = False) -> Column:  # noqa: B006
    """Tokens of a family-to-points map: each reached level of a graded family, a binary family alone, families in the given order."""
    parts = []
    for f in order:
        points = F.coalesce(F.try_element_at(ap, F.lit(f)), F.lit(0))
        if f in binary:
            held = F.array_contains(F.map_keys(ap), f) if keep_zero_binary else points > 0
            parts.append(F.when(held, F.array(F.lit(f))).otherwise(F.array().cast("array<string>")))
        else:
            parts.append(graded_tags(F.lit(f), points, levels))
    return F.flatten(F.array(*parts))


def capstone_tags(ap: Column, binary: list[str] = [], levels: tuple[int, ...] = LADDER) -> Column:  # noqa: B006
    """Only the highest token of each family, sorted; an empty set is the null token."""
    entries = F.transform(F.map_entries(ap), lambda e: F.when(
        e["key"].isin(binary), F.when(e["value"] > 0, e["key"])).otherwise(F.concat_ws("_", e["key"], level_of(e["value"], levels))))
    entries = F.filter(entries, lambda t: t.isNotNull() & (t.rlike("_[0-9]+$") | t.isin(binary)))
    return F.when(F.size(entries) == 0, F.array(F.lit(NULL))).otherwise(F.array_sort(entries))


def family_of(token: Column) -> Column:
    """The family of family_level; binary and special tokens are their own."""
    return F.when(token.rlike("^[a-z_]+?_[0-9]+$"), F.regexp_extract(token, "^([a-z_]+?)_([0-9]+)$", 1)).otherwise(token)


def level_in(token: Column) -> Column:
    """The level of family_level; null for others."""
    return F.when(token.rlike("^[a-z_]+?_[0-9]+$"), F.regexp_extract(token, "_([0-9]+)$", 1).cast("int"))


def slots(ap: Column) -> Column:
    """struct(mains, subs) of exactly ap points: 3 * subs = ap modulo 10, the least such subs; null where mains would be negative."""
    subs = F.pmod(ap * 7, F.lit(10)).cast("int")
    mains = ((ap - SUB * subs) / MAIN).cast("int")
    return F.when(ap - SUB * subs >= 0, F.struct(mains.alias("mains"), subs.alias("subs")))


def clean_name(name: Column) -> Column:
    """A context's name within compound tokens: space and dash become underscore, dots and apostrophes go."""
    return F.regexp_replace(F.translate(name, " -", "__"), "[.']", "")


def hashed(*parts: Column | str) -> Column:
    """A key that orders rows at random but always alike: md5 of the parts and what separates them."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
