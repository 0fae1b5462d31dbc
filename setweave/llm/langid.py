"""Language identification by Bayesian evidence fusion.

A text's likelihood under each language comes from character n-grams. It is combined
with what the page declares, what its address ends in, and what its host
usually holds: host priors fall back on the site, the suffix and the
whole corpus, each smoothed by the level above and counted by grouped
aggregation over all rows, the row itself left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setweave.functions.session import written
from setweave.llm.workers import give_back

#: Texts fitted for each declared language, their longest length; least rows, or else least share of them, that make a declared tag a language.
SAMPLE, SAMPLE_CHARS, LEAST_ROWS, LEAST_SHARE = 400, 20_000, 20, 0.005
#: Least share of a text's n-grams, word by word, that some language must know for the text to count as evidence.
KNOWN = 0.5
#: Weight of one word's likelihood (neighbouring n-grams are not independent), the most a text may weigh, smoothing counts, words a task remembers.
TEMPER, MOST, SMOOTH, CACHE = 0.5, 40.0, 10.0, 100_000
#: Times the sample that is taken of a tag's texts before the least hashes are picked.
SPARE = 8
#: Keys of a level of the host prior that are broadcast at most; more are joined by shuffle.
SMALL = 10_000
UNKNOWN = "und"
_EDGE = ".,;:!?\"'()[]{}<>|%$&*#@~_-+=/\\0123456789"


def grams(word: str) -> list[str]:
    """Character 2- and 3-grams of a word with marked ends; none without letters."""
    w = word.strip(_EDGE)
    if not w:
        return []
    m = f"<{w}>"
    return [*map(str.__add__, m, m[1:]), *[m[i : i + 3] for i in range(len(m) - 2)]]


def fit(texts: list[str], tags: list[str], languages: list[str]) -> dict[str, np.ndarray]:
    """N-gram to centred log-likelihoods by language, from labelled texts."""
    counts = [Counter() for _ in languages]
    place = {lang: i for i, lang in enumerate(languages)}
    for t, tag in zip(texts, tags):
        if tag in place:
            for w, n in Counter(t.lower().split()).items():
                for g in grams(w):
                    counts[place[tag]][g] += n
    names = sorted(set().union(*counts)) if counts else []
    m = np.array([[c[g] for c in counts] for g in names], float).reshape(len(names), len(languages))
    logs = np.log(m + 0.5) - np.log(m.sum(0) + 0.5 * max(1, len(names)))
    return {g: row - row.mean() for g, row in zip(names, logs)}


class TextModel:
    """Tempered log-likelihoods of whole texts; remembers the words met."""

    def __init__(self, table: dict[str, np.ndarray], n: int) -> None:
        self.n, self.place = n, {g: i for i, g in enumerate(table)}
        self.logs = np.array([*table.values(), np.zeros(n)]).reshape(len(table) + 1, n)  # the last row stands for unknown n-grams
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, n + 2))

    def _learn(self, words: list[str]) -> None:
        """Rows of new words: mean log-likelihood of their n-grams, 1 where there are letters, and the share of their n-grams that is known."""
        found = [grams(w) for w in words]
        sizes = np.array([len(f) for f in found])
        get, none = self.place.get, len(self.place)
        flat = np.array([get(g, none) for f in found for g in f], np.int64)
        rows = np.zeros((len(words), self.n + 2))
        some = sizes > 0
        if some.any():
            starts = (np.cumsum(sizes) - sizes)[some]
            rows[some, :-2] = np.add.reduceat(self.logs[flat], starts, axis=0) / sizes[some, None]
            rows[some, -2] = 1
            rows[some, -1] = np.add.reduceat((flat != none).astype(float), starts) / sizes[some]
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.rows = np.concatenate([self.rows[:first], rows])

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, int, bool]]:
        """(log-likelihood by language, words with letters, whether enough n-grams are known) of each text."""
        split = [t.lower().split() for t in texts]
        words = set().union(*split)
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = words
        if new:
            self._learn(list(new))
        out = []
        for w in split:
            total = self.rows[np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))].sum(0) if w else np.zeros(self.n + 2)
            known = bool(total[-1] >= KNOWN * total[-2])
            ll = total[:-2] * TEMPER * 3 if known else np.zeros(self.n)
            spread = ll.max() - ll.min() if self.n else 0.0
            out.append((ll * (MOST / spread) if spread > MOST else ll, int(total[-2]), known))
        return out


def train(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], dict[str, np.ndarray]]:
    """(languages, n-gram table) from columns text and declared.

    Languages are the declared tags of LEAST_ROWS rows or LEAST_SHARE of all tagged rows, whichever is less; each is fitted on at most
    `sample` different texts, by hash of the text: copies count once, however many rows they are.
    """
    counts = {r.declared: r["count"] for r in rows.where("declared <> ''").groupBy("declared").count().collect()}
    total = sum(counts.values())
    languages = sorted(t for t, n in counts.items() if n >= min(LEAST_ROWS, LEAST_SHARE * total))
    if not languages:
        return [], {}
    short = rows.where(F.length("text") <= SAMPLE_CHARS)
    at, w = F.xxhash64("text"), Window.partitionBy("declared").orderBy(F.xxhash64("text"), "text")

    def least(sizes: dict[str, int]) -> list:
        """The texts of least hash of these tags; those lie under a bound by a tag's size, so what meets in a task does not grow with the rows."""
        bound = {t: min((1 << 63) - 1, -(1 << 63) + (SPARE * sample << 64) // max(1, n)) for t, n in sizes.items()}
        under = F.element_at(F.create_map(*[F.lit(x) for t in bound for x in (t, bound[t])]), F.col("declared"))
        some = short.where(F.col("declared").isin(list(sizes)) & (at <= under)).select("declared", "text").distinct()
        return some.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample).drop("_r").collect()

    found = least({t: counts[t] for t in languages})
    got = Counter(r.declared for r in found)
    few = [t for t in languages if got[t] < min(sample, counts[t])]
    if few:  # a tag of copies: its different texts are counted, and the bound follows these
        distinct = short.where(F.col("declared").isin(few)).select("declared", at.alias("h")).distinct().groupBy("declared").count().collect()
        found = [r for r in found if r.declared not in few] + least({r.declared: r["count"] for r in distinct}) if distinct else found
    found = sorted(found)
    return languages, fit([r.text for r in found], [r.declared for r in found], languages)


def tag_of(lang: Column) -> Column:
    """Primary subtag in lower case; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(lang), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1), F.lit(""))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host, site, suffix): visible text, markup language and address parts; nulls are empty."""
    html = F.coalesce("html", F.lit(""))
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    seen = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav)\b.*?</\1\s*>|<[^>]*>", " ")
    return pages.select(
        "page_id", seen.alias("text"), tag_of(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-zA-Z_-]+)""", 1)).alias("declared"),
        host.alias("host"), F.substring_index(host, ".", -2).alias("site"), F.substring_index(host, ".", -1).alias("suffix"))


def with_likelihoods(rows: DataFrame, languages: list[str], table: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    """keys, declared, host, site, suffix, ll (array by language), words and own (the likeliest language's place, -1 without words or where most n-grams are unknown)."""
    carried = [*keys, "declared", "host", "site", "suffix"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    @F.pandas_udf("ll array<double>, words int, own int")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = TextModel(table, len(languages))
        try:
            for t in texts:
                made = [m for lo in range(0, len(t), 100) for m in model(t.iloc[lo : lo + 100].tolist())]
                yield pd.DataFrame({"ll": [m[0].tolist() for m in made], "words": [m[1] for m in made],
                                    "own": [int(np.argmax(m[0])) if m[1] and m[2] and len(languages) else -1 for m in made]})
        finally:
            del model
            give_back()

    assert set(carried) <= set(kinds)
    return rows.select(*carried, score(F.coalesce("text", F.lit(""))).alias("s")).select(*carried, "s.*")


def fuse(scored: DataFrame, languages: list[str], levels: tuple[str, ...] = ("suffix", "site", "host")) -> DataFrame:
    """scored with language and posterior; levels are the columns of the prior, each smoothed by the one before it.

    Log posterior = text likelihood + log P(declared | language) + log P(language | host), where the
    host's share is smoothed by its site's, that by the suffix's, that by the corpus's; P(declared |
    language) comes from all rows' text languages. Rows with no words, or words that no
    language knows, and no declared language are 'und'. Ties go to the language first in order. Scoring a row
    reads its whole text; rows that repeat are told apart by nothing and get the same answer.
    """
    n = len(languages)
    if not n:
        return scored.withColumn("language", F.lit(UNKNOWN)).withColumn("posterior", F.lit(0.0))

    def counts(*by: str) -> DataFrame:
        return scored.where("own >= 0").groupBy(*by).agg(*[F.count_if(F.col("own") == i).cast("double").alias(f"c{i}") for i in range(n)]).select(
            *by, F.array(*[f"c{i}" for i in range(n)]).alias("c_" + (by[0] if by else "all")))

    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col("own")).cast("double"))
    zeros = F.array_repeat(F.lit(0.0), n)
    # Small dimensions (corpus, declared tags) come as literals; suffix, site and host are joined.
    corpus = counts().first()
    corpus = list(corpus[0]) if corpus and corpus[0] else [0.0] * n
    told = {r.declared: list(r.c_declared) for r in counts("declared").where(F.col("declared").isin([*languages, ""])).collect()}
    rows = scored
    for level in levels:
        known = written(counts(level))
        rows = rows.join(F.broadcast(known) if known.count() <= SMALL else known, level, "left")

    def shares(c: Column, above: Column) -> Column:
        less = F.zip_with(F.coalesce(c, zeros), F.col("_own"), lambda a, b: a - b)
        total = F.aggregate(less, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(less, above, lambda a, p: (a + SMOOTH * p) / (total + SMOOTH))

    base = F.array(*[F.lit((x + 1) / (sum(corpus) + n)) for x in corpus])
    rows = rows.withColumn("_own", own).withColumn("_p", base)
    for level in levels:
        rows = rows.withColumn("_p", shares(F.col(f"c_{level}"), F.col("_p")))
    spoken = F.lit(None)
    for tag in languages:
        row = [math.log((told.get(tag, [0.0] * n)[i] + 1) / (corpus[i] + n + 2)) for i in range(n)]
        spoken = F.when(F.col("declared") == tag, F.array(*map(F.lit, row))).otherwise(spoken)
    spoken = F.coalesce(spoken, zeros)
    logs = F.zip_with(F.zip_with(F.col("ll"), F.transform("_p", lambda p: F.log(p)), lambda a, b: a + b), spoken, lambda a, b: a + b)
    rows = rows.withColumn("_log", logs).withColumn("_top", F.array_max("_log"))
    best = (F.array_position("_log", F.col("_top")) - 1).cast("int")
    mass = F.aggregate("_log", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    blind = (F.col("own") < 0) & ~F.col("declared").isin(languages)
    return rows.withColumn("language", F.when(blind, UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, languages)), best + 1))).withColumn(
        "posterior", F.when(blind, 0.0).otherwise(1 / mass)).select(*scored.columns, "language", "posterior")


def identify_pages(pages: DataFrame) -> DataFrame:
    """(page_id, declared, suffix, host, text_language, language, posterior) of every page.

    Null or unreadable html, url and tags count as no evidence; whole pages are read, however long; repeated rows are
    answered each, alike; other columns are not read. text_language is null where
    the page shows no words or none that a language knows; language is 'und' where there is no declared tag either.
    """
    rows = page_evidence(pages)
    languages, table = train(rows)
    scored = written(with_likelihoods(rows, languages, table, ["page_id"]))
    names = F.array(*map(F.lit, languages)) if languages else F.array(F.lit(""))
    return fuse(scored, languages).select(
        "page_id", "declared", "suffix", "host", F.when(F.col("own") >= 0, F.get(names, F.col("own"))).alias("text_language"), "language", "posterior")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose language is settled: rows without any word, or with fused evidence under least for every language, go.
    Where no language can be learnt, for want of tags, all rows with words stay.

    The language column is the declared tag and the source stands for the host. Columns and other rows are unchanged; rows that repeat
    one another stay or go together. A row is known again by a 128-bit digest of its id, text, language and source.
    """
    none = F.lit("")
    parts = [F.coalesce(F.md5(F.col(c).cast("string").cast("binary")), F.lit("-")) for c in ("doc_id", "text", "lang", "source")]
    key = F.unhex(F.md5(F.concat_ws(" ", *parts)))
    evidence = docs.select(
        key.alias("_key"), F.coalesce("text", none).alias("text"), tag_of(F.col("lang")).alias("declared"), F.coalesce("source", none).alias("host"), none.alias("site"), none.alias("suffix"))
    languages, table = train(evidence)
    scored = written(with_likelihoods(evidence, languages, table, ["_key"]))
    settled = scored.where("words > 0")
    if languages:
        settled = fuse(settled, languages, ("host",)).where((F.col("posterior") >= least) & (F.col("language") != UNKNOWN))
    return docs.withColumn("_key", key).join(settled.select("_key").distinct(), "_key", "left_semi").drop("_key")
