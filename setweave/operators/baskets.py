"""Token-set analytics: TF-IDF, itemsets, interactions, neighbours and completion."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.session import forget, written


def idf(tokens: DataFrame, doc: str, token: str, n: int) -> DataFrame:
    """(token, df, idf): ln(n + 1) - ln(df + 1) over distinct documents."""
    g = tokens.select(doc, token).distinct().groupBy(token).agg(F.count(F.lit(1)).alias("df"))
    return g.withColumn("idf", F.log(F.lit(n + 1.0)) - F.log(F.col("df") + 1.0))


def tf_idf(subset: DataFrame, weights: DataFrame, token: str) -> DataFrame:
    """(token, tf, idf, tf_idf) of the token occurrences in a subset; tokens without a weight count zero."""
    tf = subset.groupBy(token).agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(weights.select(token, "idf"), token, "left").withColumn("tf_idf", F.col("tf") * F.coalesce("idf", F.lit(0.0)))


def within_tf_idf(tokens: DataFrame, by: str, token: str) -> DataFrame:
    """(by, token, tf, idf, tf_idf) with tf = c / T and idf = ln(T / c) within each sample."""
    g = tokens.groupBy(by, token).agg(F.count(F.lit(1)).alias("c"))
    t = F.sum("c").over(Window.partitionBy(by))
    return g.withColumn("tf", F.col("c") / t).withColumn("idf", F.log(t / F.col("c"))).withColumn("tf_idf", F.col("tf") * F.col("idf"))


def normalised_tf_idf(tokens: DataFrame, doc: str, token: str, n: int, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(doc, token, score): counts times ln((1 + n) / (1 + df)) + 1, rows of unit length, terms of too few or too many documents left out."""
    c = tokens.groupBy(doc, token).agg(F.count(F.lit(1)).alias("c"))
    df = c.groupBy(token).agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(min_df, int(max_df * n)))
    w = c.join(df, token).withColumn("w", F.col("c") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return w.select(doc, token, (F.col("w") / norm).alias("score"))


def cluster_profile(scores: DataFrame, members: DataFrame, doc: str, cluster: str, token: str, k: int) -> DataFrame:
    """(cluster, token, mean, rank): mean score over all documents of a cluster, its k highest tokens."""
    size = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    g = scores.join(members, doc).groupBy(cluster, token).agg(F.sum("score").alias("_s")).join(size, cluster).withColumn("mean", F.col("_s") / F.col("_n"))
    w = Window.partitionBy(cluster).orderBy(F.desc(F.round("mean", 9)), token)
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(cluster, token, "mean", "rank")


def cluster_names(profile: DataFrame, cluster: str, token: str, least: float) -> DataFrame:
    """(cluster, name): tokens with a mean over least, best first, joined by a comma."""
    g = profile.where(F.col("mean") > least).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct((-F.round("mean", 9)).alias("m"), token))).alias("t"))
    return g.select(cluster, F.array_join(F.transform("t", lambda x: x[token]), ", ").alias("name"))


def collapsed_variants(scores: DataFrame, cluster: str, token: str, score: str, buffer: float = 0.02) -> DataFrame:
    """(cluster, token, score): of the variants of a base (`base_12`, `base_29`, `base`) in a cluster the one that survives.

    Variants are looked at from the highest score down (of equal ones the higher number first); each takes the place of the one before it if its number is higher and its score no more than
    `buffer` under that one's. A token without a number has number -1.
    """
    number = F.regexp_extract(token, r"_(\d+)$", 1)
    rows = scores.select(cluster, F.regexp_replace(token, r"_\d+$", "").alias("_base"), F.struct(F.col(score).cast("double").alias("s"), F.when(number == "", -1).otherwise(number.cast("long")).cast("long").alias("n"), F.col(token).alias("t")).alias("v"))
    best = rows.groupBy(cluster, "_base").agg(F.sort_array(F.collect_list("v"), asc=False).alias("_l"))  # a base has a few levels
    kept = F.aggregate(F.slice("_l", F.lit(2), F.size("_l")), F.element_at("_l", 1), lambda a, x: F.when((x["s"] >= a["s"] - buffer) & (x["n"] > a["n"]), x).otherwise(a))
    return best.select(cluster, kept.alias("v")).select(cluster, F.col("v.t").alias(token), F.col("v.s").alias(score))


def names_of_clusters(scores: DataFrame, cluster: str, token: str, score: str, least: float = 0.1) -> DataFrame:
    """(cluster, name): tokens with a score over least, the highest first (ties by name), joined by a comma; a cluster without any is named by itself."""
    order = F.array_sort(F.collect_list(F.when(F.col(score) > least, F.struct((-F.round(score, 9)).alias("s"), F.col(token).alias("t")))))
    g = scores.groupBy(cluster).agg(order.alias("_l"))
    return g.select(cluster, F.when(F.size("_l") > 0, F.array_join(F.transform("_l", lambda x: x["t"]), ", ")).otherwise(F.col(cluster).cast("string")).alias("name"))


def cluster_summary(points: DataFrame, tokens: DataFrame, names: DataFrame, key: str, cluster: str, coords: list[str], top: int = 12) -> DataFrame:
    """(cluster, name, n, pct, centroid coords, representative, representative_tokens, top_tokens, n_clusters, n_noise): one row a cluster, noise being cluster -1.

    points (key, cluster, coords), tokens (key, token), names (cluster, name). The representative is the point nearest to the centroid (ties to the smaller key); top_tokens are the `top` most counted
    in the cluster, ties by name. Distances come from one pass after the centroids; a cluster's points are never gathered.
    """
    centre = points.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(coords)])
    far = sum(((F.col(c) - F.col(f"_m{i}")) * (F.col(c) - F.col(f"_m{i}")) for i, c in enumerate(coords)), F.lit(0.0))
    near = points.join(centre, cluster).groupBy(cluster).agg(F.min(F.struct(F.round(far, 12).alias("d"), F.col(key).alias("k"))).alias("_r")).select(cluster, F.col("_r.k").alias("representative"))
    counted = tokens.select(key, "token").join(points.select(key, cluster), key).groupBy(cluster, "token").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(cluster).orderBy(F.desc("_c"), "token")
    listed = counted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", "token", "_c").alias("t")))).alias("_l"))
    listed = listed.select(cluster, F.array_join(F.transform("_l", lambda x: x["t"]), " ").alias("top_tokens"))
    own = near.join(tokens.select(F.col(key).alias("representative"), "token"), "representative").groupBy(cluster).agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("representative_tokens"))
    total = centre.agg(F.sum("n").alias("_all"), F.count_if(F.col(cluster) != -1).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col(cluster) == -1, F.col("n"))), F.lit(0)).alias("n_noise"))
    out = centre.join(near, cluster).join(listed, cluster, "left").join(own, cluster, "left").join(names.select(cluster, "name"), cluster, "left").join(F.broadcast(total))
    name = F.when(F.col(cluster) == -1, "noise").otherwise(F.coalesce("name", F.col(cluster).cast("string")))
    return out.select(cluster, name.alias("name"), "n", (100.0 * F.col("n") / F.col("_all")).alias("pct"), *[F.col(f"_m{i}").alias(c) for i, c in enumerate(coords)], "representative",
                      F.coalesce("representative_tokens", F.lit("")).alias("representative_tokens"), F.coalesce("top_tokens", F.lit("")).alias("top_tokens"), "n_clusters", "n_noise")


def subsets(tokens: Column, size: int) -> Column:
    """All subsets of 2 to 4 of a sorted token array, joined by '|'. Sets are bounded by the token families, so the list is."""
    if size not in (2, 3, 4):
        raise ValueError("subsets of 2, 3 or 4")
    return _joined(tokens, size)


def _joined(tokens: Column, size: int) -> Column:
    if size == 1:
        return tokens
    n = F.size(tokens)

    def led_by(i: Column) -> Column:
        rest = F.slice(tokens, i + 1, F.greatest(n - i, F.lit(0)))
        return F.transform(_joined(rest, size - 1), lambda y: F.concat_ws("|", F.element_at(tokens, i), y))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), led_by))


def conditioned(sets: DataFrame, token: str) -> DataFrame:
    """sets (tokens, ...) that contain token, without it; sets of it alone go."""
    return sets.where(F.array_contains("tokens", token)).withColumn("tokens", F.array_remove("tokens", token)).where(F.size("tokens") > 0)


def collapsed(sets: DataFrame, family) -> DataFrame:
    """sets with tokens replaced by their families, each once and in order; family maps a token column to one."""
    return sets.withColumn("tokens", F.array_sort(F.array_distinct(F.transform("tokens", family))))


def itemset_lift(sets: DataFrame, size: int | tuple[int, ...], least_support: float, k: int, high: str = "high") -> DataFrame:
    """(itemset, n_high, n_base, support_high, support_base, lift): itemsets of a size, or of several, frequent among the high rows against the rest.

    sets (tokens sorted array, high boolean). Itemsets grow from tokens that are frequent themselves, so
    the candidates of a row are subsets of its frequent tokens; counts are combined before the shuffle. conditioned() and
    collapsed() make the sets that hold a token and sets of families.
    """
    sizes = (size,) if isinstance(size, int) else size
    total = sets.agg(F.count_if(high).alias("nh"), F.count_if(~F.col(high)).alias("nb")).first()
    floor = max(1, int(total.nh * least_support))
    one = sets.where(high).select(F.explode("tokens").alias("t")).groupBy("t").count().where(F.col("count") >= floor).select("t")
    frequent = one.agg(F.coalesce(F.array_sort(F.collect_list("t")), F.array().cast("array<string>")).alias("_f"))  # at most 1 / least_support times a set's size
    kept = sets.join(F.broadcast(frequent)).select(F.array_intersect("tokens", "_f").alias("tokens"), high).where(F.size("tokens") >= min(sizes))
    g = kept.select(F.explode(F.concat(*[subsets(F.col("tokens"), n) for n in sizes])).alias("itemset"), high).groupBy("itemset").agg(
        F.count_if(high).alias("n_high"), F.count_if(~F.col(high)).alias("n_base")).where(F.col("n_high") >= floor)
    sh, sb = F.col("n_high") / float(max(1, total.nh)), F.col("n_base") / float(max(1, total.nb))
    lift = F.when(sb > 0, sh / sb).otherwise(999.0)
    return g.select("itemset", "n_high", "n_base", sh.alias("support_high"), sb.alias("support_base"), lift.alias("lift")).orderBy(F.desc(F.round("lift", 9)), "itemset").limit(k)


def interactions(tokens: DataFrame, n: int, k: int, least: int = 5, token: str = "token", by: str = "example_id") -> DataFrame:
    """(a, b, n_both, expected, interaction): pairs of the k commonest tokens, seen together against independence, by (seen - expected) / max(expected, 1)."""
    t = tokens.select(by, token).distinct()
    top = t.groupBy(token).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), token).limit(k)
    x = t.join(F.broadcast(top), token).groupBy(by).agg(F.array_sort(F.collect_list(token)).alias("s"))  # k tokens at most
    pairs = x.select(F.explode(subsets(F.col("s"), 2)).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= least)
    split = pairs.select(F.substring_index("p", "|", 1).alias("a"), F.substring_index("p", "|", -1).alias("b"), "n_both")
    side = lambda c, n_: top.select(F.col(token).alias(c), F.col("c").alias(n_))
    g = split.join(F.broadcast(side("a", "ca")), "a").join(F.broadcast(side("b", "cb")), "b")
    e = F.col("ca") * F.col("cb") / F.lit(float(n))
    return g.select("a", "b", "n_both", e.alias("expected"), ((F.col("n_both") - e) / F.greatest(e, F.lit(1.0))).alias("interaction"))


def common_cores(sets: DataFrame, least: int, k: int) -> DataFrame:
    """(core, n): whole sets of 2 to 6 tokens and all subsets of 2 and 3, by how many sets hold them."""
    whole = sets.where(F.size("tokens").between(2, 6)).select(F.array_join("tokens", "|").alias("core"), F.size("tokens").alias("z"), "tokens")
    parts = whole.select(F.explode(F.array_distinct(F.concat(F.array("core"), subsets(F.col("tokens"), 2), subsets(F.col("tokens"), 3)))).alias("core"))
    return parts.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "core").limit(k)


def pmi_penalty(builds: DataFrame, train: DataFrame, ctx: str = "ctx", key: str = "example_id", item: str = "family") -> DataFrame:
    """(key, pmi_penalty): sum over a set's pairs of max(0, -PMI) in its context's training sets; 0 for fewer than two items."""
    eps = 1e-12
    sets = train.groupBy(ctx, key).agg(F.array_sort(F.collect_set(item)).alias("s"))
    n = sets.groupBy(ctx).agg(F.count(F.lit(1)).alias("n"))
    one = sets.select(ctx, F.explode("s").alias("a")).groupBy(ctx, "a").agg(F.count(F.lit(1)).alias("c"))
    two = sets.select(ctx, F.explode(subsets(F.col("s"), 2)).alias("p")).groupBy(ctx, "p").agg(F.count(F.lit(1)).alias("cab"))
    own = builds.groupBy(ctx, key).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = own.select(ctx, key, F.explode(subsets(F.col("s"), 2)).alias("p")).withColumn("a", F.substring_index("p", "|", 1)).withColumn("b", F.substring_index("p", "|", -1))
    g = pairs.join(F.broadcast(n), ctx, "left").join(two, [ctx, "p"], "left").join(one.withColumnRenamed("c", "ca"), [ctx, "a"], "left").join(
        one.select(ctx, F.col("a").alias("b"), F.col("c").alias("cb")), [ctx, "b"], "left").na.fill(0, ["n", "cab", "ca", "cb"])
    share = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    pmi = F.log((share("cab") + eps) / ((share("ca") + eps) * (share("cb") + eps)))
    sums = g.groupBy(key).agg(F.sum(F.greatest(F.lit(0.0), -pmi)).alias("pmi_penalty"))
    return own.select(key).join(sums, key, "left").na.fill(0.0)


#: Likenesses at which a nearest set is looked for, one after the other; the last takes any common item.
STEPS = (0.8, 0.6, 0.4, 0.2, 0.0)
#: Subsets that a set is listed by at most; sets with more are met through their rarest items.
SUBSETS = 1024


def _rare_first(sets: DataFrame, ctx: str, items: str, spread: DataFrame) -> DataFrame:
    """The distinct sets with their items from the rarest to the most widespread, in an order that a context shares."""
    one = sets.select(ctx, F.col(items).alias("_set"), F.explode(items).alias("_i")).join(spread, [ctx, "_i"], "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("d"), F.col("_i").alias("i"))))
    return one.groupBy(ctx, "_set").agg(order.alias("o")).select(ctx, F.col("_set").alias(items), F.col("o.i").alias("_o"))


def _least_kept(size: int, t: float) -> int:
    """How many items of a set of this size it shares at least with one of likeness t."""
    return max(1, math.ceil(size * t - 1e-9))


def _listed_sizes(t: float) -> list[int]:
    """Sizes, up to 64, of sets that have at most SUBSETS subsets as large as what they share with a set of likeness t."""
    return [n for n in range(1, 65) if sum(math.comb(n, k) for k in range(_least_kept(n, t), n + 1)) <= SUBSETS]


def _subsets(items: str, t: float) -> Column:
    """The subsets of a sorted array that leave out as many items at most as likeness t allows, in its order."""
    size = F.size(items)
    spare = size - F.greatest(F.lit(1), F.ceil(size * t - 1e-9).cast("int"))
    at = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    none = F.array(F.slice(items, F.lit(1), F.lit(0)))
    return F.aggregate(at, none, lambda found, a: F.concat(F.transform(found, lambda y: F.concat(y, F.array(a["x"]))), F.filter(found, lambda y: a["i"] - F.size(y) < spare)))


def _nearest_by_subsets(asked: DataFrame, held: DataFrame, ctx: str, t: float) -> DataFrame:
    """(ctx, s, nearest) of the sets asked (ctx, s) whose best among held (ctx, r) can reach t; what is told is reached, and is the best where that is t or more.

    Two sets share a subset as large as their common items, and of all that hold a subset the smallest is nearest by it: so sets meet the least size of each subset.
    """
    theirs = held.select(ctx, F.size("r").alias("_n"), F.explode(_subsets("r", t)).alias("_i")).groupBy(ctx, "_i").agg(F.min("_n").alias("_n"))
    mine = asked.select(ctx, "s", F.explode(_subsets("s", t)).alias("_i"))
    return mine.join(theirs, [ctx, "_i"]).groupBy(ctx, "s").agg(F.max(F.size("_i") / (F.size("s") + F.col("_n") - F.size("_i"))).alias("nearest"))


def _nearest_by_items(asked: DataFrame, held: DataFrame, ctx: str, t: float) -> DataFrame:
    """The same by comparing the sets (_o: rarest items first) that share one of the first |s| - ceil(t |s|) + 1 items of each."""

    def front(o: str) -> Column:
        size = F.size(o)
        return F.slice(o, F.lit(1), size - F.ceil(size * t - 1e-9).cast("int") + 1 if t else size)

    mine = asked.select(ctx, "s", front("_o").alias("_sf"))
    theirs = held.select(ctx, "r", front("_o").alias("_rf"))
    met = mine.withColumn("_i", F.explode("_sf")).join(theirs.withColumn("_i", F.explode("_rf")), [ctx, "_i"])
    alike = F.least(F.size("s"), F.size("r")) >= t * F.greatest(F.size("s"), F.size("r")) - 1e-9
    once = F.element_at(F.array_intersect("_sf", "_rf"), 1) == F.col("_i")  # of several common items the first
    n = F.size(F.array_intersect("s", "r"))
    return met.where(alike & once).groupBy(ctx, "s").agg(F.max(n / (F.size("s") + F.size("r") - n)).alias("nearest"))


def nearest_jaccard(sets: DataFrame, references: DataFrame, ctx: str = "ctx", key: str = "example_id", item: str = "family") -> DataFrame:
    """(key, nearest): highest Jaccard likeness of a set to the distinct reference sets of its context, 0 where none shares an item.

    Distinct sets are looked up among equal ones first, then at falling likenesses; a set whose best is t or more is settled, and only the others go on to a
    lower one. Two sets of a likeness t share a subset of ceil(t |s|) items or more of each, so sets that have few of these meet on them, by the least size of
    a set that holds it: no two sets are compared. Where one of them has many, they meet on their rarest items: their sizes differ by a factor t at most, and
    they share one of the first |s| - ceil(t |s|) + 1 items of each.
    """
    own = written(sets.groupBy(ctx, key).agg(F.array_sort(F.collect_set(item)).alias("s")))
    ref = written(references.groupBy(ctx, key).agg(F.array_sort(F.collect_set(item)).alias("r")).where(F.size("r") > 0).select(ctx, "r").distinct())
    spread = ref.select(ctx, F.explode("r").alias("_i")).groupBy(ctx, "_i").agg(F.count(F.lit(1)).alias("_df"))
    held = written(_rare_first(ref, ctx, "r", spread))
    asked = written(_rare_first(own.select(ctx, "s").distinct(), ctx, "s", spread))
    equal = written(asked.join(ref.withColumnRenamed("r", "s"), [ctx, "s"], "left_semi").select(ctx, "s", F.lit(1.0).alias("nearest")))
    settled, used = [equal], [own, ref, held, asked]
    still = written(asked.join(equal, [ctx, "s"], "left_anti"))
    most = held.agg(F.max(F.size("r")).alias("n")).first().n or 0
    for t in STEPS:
        used.append(still)
        if still.isEmpty():
            break
        few = _listed_sizes(t)
        small, large = (lambda c: F.size(c).isin(few)), (lambda c: ~F.size(c).isin(few))
        found = _nearest_by_subsets(still.where(small("s")), held.where(small("r")), ctx, t)
        found = found.unionByName(_nearest_by_items(still.where(large("s")), held, ctx, t))
        if not set(range(1, most + 1)) <= set(few):
            found = found.unionByName(_nearest_by_items(still.where(small("s")), held.where(large("r")), ctx, t))
        best = found.groupBy(ctx, "s").agg(F.max("nearest").alias("nearest"))
        settled.append(written(best.where(F.col("nearest") >= t - 1e-9)))
        still = written(still.join(settled[-1], [ctx, "s"], "left_anti"))
    best = functools.reduce(DataFrame.unionByName, settled)
    out = written(own.join(ref.select(ctx).distinct(), ctx).join(best, [ctx, "s"], "left").select(key, F.coalesce("nearest", F.lit(0.0)).alias("nearest")))
    forget(*used, *settled, still)
    return out


def numbered(items: Column) -> Column:
    """A sorted array with repeats as distinct units: the n-th copy of an item is item#n, so multisets contain one another as sets do."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit("#"), (i - F.array_position(items, x).cast("int") + 2).cast("string")))


def rarest_item(sets: DataFrame, references: DataFrame, by: list[str], items: str, held: str) -> DataFrame:
    """sets (by, items) with _rare: the item of each that the fewest reference rows (by, held) hold; null where one is in none."""
    df = references.select(*by, F.explode(held).alias("_i")).groupBy(*by, "_i").agg(F.count(F.lit(1)).alias("_df"))
    met = sets.select(*by, items, F.explode(items).alias("_i")).join(df, [*by, "_i"], "left").groupBy(*by, items).agg(
        F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("d"), F.col("_i").alias("i"))).alias("_m"))
    return met.select(*by, items, F.when(F.col("_m.d") > 0, F.col("_m.i")).alias("_rare"))


def mode_completion(cases: DataFrame, references: DataFrame, slots: int, ctx: str = "ctx", key: str = "example_id") -> DataFrame:
    """(key, completed): each case's observed items, filled up to `slots` from the commonest full multiset of the context that contains them, else from the context's commonest.

    cases (key, ctx, observed) and references (ctx, full) hold sorted arrays with repeats. What is observed stays; missing slots take the full
    multiset's further items in order and, when these run out, its items again from the first. Distinct multisets meet by the
    observed item that the fewest of the context hold. Of equally common ones the first in order counts.
    """
    full = references.groupBy(ctx, numbered(F.col("full")).alias("full")).agg(F.count(F.lit(1)).alias("n"))
    seen = cases.select(ctx, numbered(F.col("observed")).alias("observed")).distinct()
    best = F.min(F.struct((-F.col("n")).alias("n"), F.array_join("full", "|").alias("o"), F.col("full").alias("full"))).alias("_best")
    mode = full.groupBy(ctx).agg(best).select(ctx, F.col("_best.full").alias("_mode"))
    asked = rarest_item(seen.where(F.size("observed") > 0), full, [ctx], "observed", "full").where("_rare is not null")
    held = asked.join(full.select(ctx, "full", "n", F.explode("full").alias("_rare")), [ctx, "_rare"]).where(F.size(F.array_except("observed", "full")) == 0)
    chosen = held.groupBy(ctx, "observed").agg(best).select(ctx, "observed", F.col("_best.full").alias("_held"))
    found = seen.join(chosen, [ctx, "observed"], "left").join(mode, ctx, "left").withColumn("_full", F.coalesce("_held", "_mode"))
    plain = lambda a: F.transform(a, lambda x: F.substring_index(x, "#", 1))
    missing = F.greatest(F.lit(slots) - F.size("observed"), F.lit(0))
    further = F.slice(F.array_except("_full", "observed"), F.lit(1), missing)
    again = F.when(F.size(further) < missing, F.transform(F.sequence(F.size(further), missing - 1), lambda i: F.element_at(F.col("_full"), (i % F.size("_full") + 1).cast("int")))).otherwise(F.array().cast("array<string>"))
    filled = F.array_sort(plain(F.concat("observed", further, again)))
    done = found.select(ctx, "observed", F.when(F.col("_full").isNotNull(), F.array_join(filled, "|")).alias("completed"))
    return cases.withColumn("observed", numbered(F.col("observed"))).join(done, [ctx, "observed"], "left").select(key, "completed")


def priors(tokens: DataFrame, ctx: str, token: str, weight: float, by: str = "example_id") -> DataFrame:
    """(ctx, token, prior): weight P(token | context) + (1 - weight) P(token) over sets."""
    t = tokens.select(by, ctx, token).distinct()
    n = t.groupBy(ctx).agg(F.count_distinct(by).alias("n"))
    c = t.groupBy(ctx, token).agg(F.count(F.lit(1)).alias("c"))
    g = t.groupBy(token).agg(F.count(F.lit(1)).alias("g"))
    total = t.agg(F.count_distinct(by).alias("tn"))
    return c.join(F.broadcast(n), ctx).join(g, token).join(F.broadcast(total)).select(ctx, token, (weight * F.col("c") / F.col("n") + (1 - weight) * F.col("g") / F.col("tn")).alias("prior"))


def one_shot(probabilities: DataFrame, current: DataFrame, threshold: float, by: str = "ctx") -> DataFrame:
    """(by, family, level, p): graded tokens with p at or above threshold whose level is over the family's current one, the highest of each family."""
    held = current.select(by, "family", F.col("level").alias("_now"))
    x = probabilities.join(held, [by, "family"], "left").where((F.col("p") >= threshold) & (F.col("level") > F.coalesce("_now", F.lit(0))))
    return x.groupBy(by, "family").agg(F.max("level").alias("level"), F.max_by("p", "level").alias("p"))


def contrasts(scored: DataFrame, by: str = "base") -> DataFrame:
    """(a, b, mean, stderr, n): two-way contrasts f_ij - f_i - f_j + f_0 of scored variants (base, variant '', 'a', 'b', 'a|b'; score), over bases."""
    f0 = scored.where("variant = ''").select(by, F.col("score").alias("f0"))
    one = scored.where("variant <> '' and not contains(variant, '|')")
    two = scored.where("contains(variant, '|')").select(by, F.substring_index("variant", "|", 1).alias("a"), F.substring_index("variant", "|", -1).alias("b"), F.col("score").alias("fab"))
    side = lambda c, v: one.select(by, F.col("variant").alias(c), F.col("score").alias(v))
    x = two.join(side("a", "fa"), [by, "a"]).join(side("b", "fb"), [by, "b"]).join(f0, by).withColumn("i", F.col("fab") - F.col("fa") - F.col("fb") + F.col("f0"))
    return x.groupBy("a", "b").agg(F.avg("i").alias("mean"), (F.stddev_samp("i") / F.sqrt(F.count(F.lit(1)))).alias("stderr"), F.count(F.lit(1)).alias("n"))
