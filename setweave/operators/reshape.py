"""Reshaping and tokenization of wide logs, maps and token sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.session import written
from setweave.functions.tokens import PAD, SUB_SLOTS, TOTAL, family_of, level_in
from setweave.operators.ranking import global_rank


def melt_groups(wide: DataFrame, prefixes: dict[str, list], tags: list[str], fields: list[str], keep: list[str]) -> DataFrame:
    """One row per prefix: fields `<prefix>-<field>` without the prefix, its tag values, and the columns to keep. One projection, no join."""
    rows = F.array(*[F.struct(*[F.col(f"`{p}-{f}`").alias(f) for f in fields], *[F.lit(v).alias(t) for t, v in zip(tags, values)]) for p, values in prefixes.items()])
    return wide.select(*[F.col(f"`{k}`") for k in keep], F.inline(rows))


def derive_player_columns(rows: DataFrame, names: DataFrame) -> DataFrame:
    """With weapon_id by name, rows without abilities dropped, ability_hash of set and id, win as own team's victory."""
    return rows.dropna(subset=["abilities"]).join(names, "weapon", "left").withColumn(
        "ability_hash", F.concat(F.md5("abilities"), F.col("weapon_id"))).withColumn("win", F.upper(F.substring("win", 1, 1)) == F.col("team"))


def map_chain(start: DataFrame, *steps: tuple[DataFrame, str, str]) -> DataFrame:
    """start with one column per step, each looked up by the one before; what is missing is empty."""
    for dim, key, value in steps:
        start = start.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit("")))
    return start


def canonical_ids(rows: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """key replaced by aliases' reference where it has one."""
    return rows.join(aliases.select(F.col("alias").alias(key), "reference"), key, "left").withColumn(key, F.coalesce("reference", key)).drop("reference")


def long_to_map(rows: DataFrame, by: list[str], key: str = "family", value: str = "ap") -> DataFrame:
    """One map per group from key and the sum of value; keys in order."""
    return rows.groupBy(*by, key).agg(F.sum(value).alias("_v")).groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "_v")))).alias("points"))


def capstones(tokens: DataFrame, by: str = "example_id", token: str = "token") -> DataFrame:
    """(by, family, level): the highest level of each family; special tokens left out, binary ones without level."""
    t = F.col(token)
    return tokens.where(~t.startswith("<")).groupBy(by, family_of(t).alias("family")).agg(F.max(level_in(t)).alias("level"))


def compound_tokens(rows: DataFrame, names: DataFrame, ctx: str = "ctx", token: str = "token") -> DataFrame:
    """rows with token prefixed by the cleaned name of its context; contexts without a name drop out."""
    from setweave.functions.tokens import clean_name

    return rows.join(names.select(ctx, "name"), ctx).withColumn(token, F.concat_ws("_", clean_name(F.col("name")), token)).drop("name")


def int_list(text: Column) -> Column:
    """JSON text to a list of int; unreadable text is an empty list."""
    return F.coalesce(F.from_json(text, "array<int>"), F.array().cast("array<int>"))


def validated(rows: DataFrame, vocabulary: DataFrame, token: str = "token", by: str = "example_id") -> DataFrame:
    """rows with reject_reason: unknown token, padding, or the null token mixed with others; null where valid."""
    known = rows.join(vocabulary.select(token, F.lit(True).alias("_known")), token, "left")
    w = Window.partitionBy(by)
    mixed = (F.max(F.when(F.col(token) == "<NULL>", 1)).over(w) == 1) & (F.count(F.lit(1)).over(w) > 1)
    reason = F.when(F.col(token) == PAD, "padding").when(F.col("_known").isNull(), "unknown").when(mixed, "mixed null")
    return known.withColumn("reject_reason", reason).drop("_known")


def violations(builds: DataFrame, slot_of: DataFrame | None = None) -> DataFrame:
    """(build_id, rule) of broken rules in rows (build_id, family, ap, subs[, slot, main]): total points, sub slots, negative points, a family twice, a bound family on another slot."""
    by = builds.groupBy("build_id").agg(F.sum("ap").alias("total"), F.sum("subs").alias("subs"), F.min("ap").alias("least"))
    rules = [by.where(F.col("total") > TOTAL).select("build_id", F.lit("total").alias("rule")),
             by.where(F.col("subs") > SUB_SLOTS).select("build_id", F.lit("sub slots").alias("rule")),
             by.where(F.col("least") < 0).select("build_id", F.lit("negative").alias("rule")),
             builds.groupBy("build_id", "family").count().where("count > 1").select("build_id", F.lit("family twice").alias("rule")).distinct()]
    if slot_of is not None:
        off = builds.join(F.broadcast(slot_of.select("family", F.col("slot").alias("_own"))), "family").where(F.col("slot") != F.col("_own"))
        rules.append(off.select("build_id", F.lit("wrong slot").alias("rule")).distinct())
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def absent_families(builds: DataFrame, families: DataFrame) -> DataFrame:
    """(build_id, family): families that a build does not hold. families is a small dimension of unique rows."""
    all_ = builds.select("build_id").distinct().withColumn("family", F.explode(F.lit([r[0] for r in families.select("family").distinct().orderBy("family").collect()])))
    return all_.join(builds.select("build_id", "family").distinct(), ["build_id", "family"], "left_anti")


def extend_vocabulary(tokens: DataFrame, vocabulary: DataFrame, token: str = "token", order: str = "first_seen") -> DataFrame:
    """(token, token_id): vocabulary's ids kept, unseen tokens numbered on in order of first appearance (a number; ties by name), PAD last.

    Unseen tokens are numbered in slices of their order, so no task sorts them all.
    """
    base = vocabulary.where(F.col(token) != PAD)
    start = base.agg(F.coalesce(F.max("token_id") + 1, F.lit(0)).alias("start"))
    new = tokens.groupBy(token).agg(F.min(order).alias("_at")).join(base, token, "left_anti").where(F.col(token) != PAD)
    numbered = global_rank(written(new), "_at", token, "_n").withColumn("_n", F.col("_n") - 1).join(F.broadcast(start)).select(token, (F.col("start") + F.col("_n")).cast("int").alias("token_id"))
    full = base.select(token, F.col("token_id").cast("int").alias("token_id")).unionByName(numbered)
    return full.unionByName(full.agg((F.coalesce(F.max("token_id"), F.lit(-1)) + 1).alias("token_id")).select(F.lit(PAD).alias(token), "token_id"))


def encode(tokens: DataFrame, vocabulary: DataFrame, by: str, at: str, token: str = "token") -> DataFrame:
    """(by, ids): token ids of each group in order of at."""
    return tokens.join(vocabulary, token).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(at, "token_id"))).alias("_t")).select(
        by, F.transform("_t", lambda t: t["token_id"]).alias("ids"))


def multi_hot(ids: Column, size: int, pad: int) -> Column:
    """0/1 list of vocabulary length, padding ignored."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (F.array_contains(ids, i) & (i != pad)).cast("int"))


def padded(rows: DataFrame, batch: str, ids: str, pad: int) -> DataFrame:
    """rows with ids filled with pad to the longest list of their batch, and mask true at the filling."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    fill = longest - F.size(ids)
    return rows.withColumn("mask", F.concat(F.array_repeat(F.lit(False), F.size(ids)), F.array_repeat(F.lit(True), fill))).withColumn(
        ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad), fill)))


def wide_ranks_to_long(wide: DataFrame, key: str, k: int, signs: tuple[str, ...] = ("+", "-")) -> DataFrame:
    """(key, sign, rank, token, value) from columns `+1_tok`, `+1_val` and so on; null and empty tokens drop out."""
    cells = F.array(*[F.struct(F.lit(s).alias("sign"), F.lit(r).alias("rank"), F.col(f"`{s}{r}_tok`").alias("token"), F.col(f"`{s}{r}_val`").alias("value")) for s in signs for r in range(1, k + 1)])
    return wide.select(key, F.inline(cells)).where("token is not null and token <> ''")
