"""Quality rules: base counts, then the distance of a text's histograms to those of its language.

Two histograms of a text are compared with references by Jensen-Shannon distance (base 2, 0 to 1):

* code points by class: small, capital, digit, blank, line break, stop, strong mark, symbol, beyond ASCII, other;
* words as they stand, marks and capitals included, by common word: a bin for each word that makes ``OWN_SHARE`` of the
  reference's words, one for those that make ``COMMON_SHARE``, one for all others.

References are counted over all texts, one for every language that has ``MIN_LANGUAGE`` words and a thousandth of all words,
and one for the whole corpus, which serves texts of other or no language. A text fails if a distance exceeds its limit. A
histogram of n counts lies off its source by about 1 / sqrt(n), so the limits widen by that much for short texts, and a
histogram of fewer than ``MIN_CHARS`` code points or ``MIN_WORDS`` words is not judged.

Only DataFrame functions are used. Common words make a five-hundredth of a reference's words, so there are at most 500 of
them and at most 1,000 languages; that is what is broadcast, with a bit map of ``SLOTS`` that tells most other words apart. They
are found in two passes: words fall into ``BUCKETS`` by hash, and only words of buckets that hold a five-hundredth together
are counted one by one, so rare words, most of all different ones, are never shuffled. A third pass takes all counts of every
text and the word distance; they are checkpointed without the text, and give the class references.

Stated cases: a null or empty text has no words and counts of 0, so it fails the base rules; a null language stands for the
whole corpus; equal rows are judged each; limits are exceeded, not met (ties stay); an empty table gives an empty result; one
very long text is held by one task; columns of other names pass by, those named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import col, without
from probatum.operators.grouping import once
from probatum.session import cut_lineage

MIN_WORDS, MIN_CHARS = 50, 200  # below, a histogram is not judged
WORD_LIMIT, CHAR_LIMIT = 0.18, 0.2  # distances that a long text may have
WORD_NOISE, CHAR_NOISE = 1.0, 1.5  # times 1 / sqrt(words or code points), added to the limits
COMMON_SHARE, OWN_SHARE = 1 / 500, 1 / 100
MIN_LANGUAGE, LANGUAGE_SHARE = 2_000, 1 / 1_000
BUCKETS, SLOTS = 1 << 12, 1 << 12
CLASSES = ("[A-Z]+", "[0-9]+", r"[\x0A-\x0D]+", "[.,;:]+", "[!?]+", "[#*$%&|<>]+", r"[\x{80}-\x{10FFFF}]+")  # besides [a-z], blanks and others
SYMBOLS = 7  # place of the symbols among the counts
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def class_counts(n: Column, word_chars: Column, rest: Column) -> Column:
    """Code points by class: [a-z], ``CLASSES`` with the blanks as third, others. ``rest`` is the text without [a-z] and blanks."""
    marks = [F.length(rest) - F.length(F.regexp_replace(rest, c, "")) for c in CLASSES]
    blanks = n - word_chars - marks[2]
    some = [n - blanks - F.length(rest), *marks[:2], blanks, *marks[2:]]
    return F.array(*some, n - reduce(Column.__add__, some))


FEW = 32  # different repeated windows up to which a list is cheaper than a sort by place


def repeated_words(words: str) -> tuple[dict, dict, dict, Column]:
    """Three steps for ``once`` and the result: words in windows of three that the text holds twice or more.

    The sorted hashes of the windows tell which repeat. The places of these are found by looking every window up in their list
    or, if they are many, from a sort of (hash, place); either way gives the same places.
    """
    window = F.transform(
        F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    again = F.transform(F.array(F.sort_array("window")), lambda s: F.array_distinct(
        F.filter(s, lambda x, k: F.coalesce(F.get(s, k + 1) == x, F.lit(False)))))[0]
    listed = F.transform("window", lambda x, k: F.when(F.array_contains("again", x), k))

    def twin(placed: Column) -> Column:
        def here(x: Column, k: Column) -> Column:
            # beyond the ends get() is null, which equals nothing
            return F.when(F.coalesce(F.get(placed, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed, k + 1)["h"] == x["h"], F.lit(False)), x["i"])
        return F.transform(placed, here)

    placed = F.sort_array(F.transform("window", lambda x, k: F.struct(x.alias("h"), k.alias("i"))))
    # a lambda's argument is computed once, the array it stands for would be computed for every element
    by_sort = F.sort_array(F.array_compact(F.transform(F.array(placed), twin)[0]))
    places = F.when(F.size("again") == 0, F.array().cast("array<int>")).when(F.size("again") <= FEW, F.array_compact(listed)).otherwise(by_sort)
    steps = F.transform("places", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - x, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return {"window": window}, {"again": again}, {"places": places}, covered


def divergence_term(p: Column, q: Column) -> Column:
    """A bin's share of twice the divergence, in nats."""
    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(2 * x / (p + q))).otherwise(F.lit(0.0))
    return part(p) + part(q)


def distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), twice / 2 / F.log(F.lit(2.0))))


def _bucket(word: Column, many: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(many)).cast("int")


def _bit_map(places: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(places, i))


def word_references(texts: DataFrame) -> DataFrame:
    """(lang, words, n_own, slots, shares): common words of a reference, those with a bin of their own first.

    The row of a null lang is the whole corpus. Shares: of all other words, of the common words without an own bin, of
    each own bin. ``slots`` marks the hash slots of the common words.
    """
    split = once(texts.select("lang", "text"), w=words_of(F.col("text"))).select("lang", "w")
    words = split.select("lang", F.explode("w").alias("word")).withColumn("bucket", _bucket(F.col("word"), BUCKETS))
    counts = cut_lineage(words.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("c")))
    sizes = counts.groupBy("lang").agg(F.sum("c").alias("m"))
    total = sizes.agg(F.sum("m")).first()[0] or 0
    large = F.col("lang").isNotNull() & (F.col("m") >= MIN_LANGUAGE) & (F.col("m") * round(1 / LANGUAGE_SHARE) >= total)
    named = cut_lineage(sizes.filter(large))  # at most 1,000
    many = round(1 / COMMON_SHARE)
    # buckets that may hold a common word, of a language or of the whole corpus: at most 500 for each
    heavy = counts.join(F.broadcast(named), "lang").filter(F.col("c") * many >= F.col("m")).select("lang", "bucket")
    all_heavy = counts.groupBy("bucket").agg(F.sum("c").alias("c")).filter(F.col("c") * many >= total).select("bucket")
    whole = named.sparkSession.range(1).select(F.lit(None).cast("string").alias("lang"), F.lit(total).cast("bigint").alias("m"))
    refs = named.unionByName(whole)
    # a bit map of buckets for every reference, those of the whole corpus in each
    marks = heavy.unionByName(refs.select("lang", F.lit(1).alias("one")).join(F.broadcast(all_heavy.withColumn("one", F.lit(1))), "one").drop("one"))
    maps = marks.groupBy("lang").agg(F.collect_set("bucket").alias("b")).select("lang", _bit_map(F.col("b"), BUCKETS).alias("marks"))
    maps = cut_lineage(refs.select("lang").join(maps.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "lang", F.coalesce("marks", F.array().cast("array<boolean>")).alias("marks")))
    likely = _with_reference(split, maps, ["marks"]).select("lang", F.explode(
        F.filter("w", lambda x: F.get("marks", _bucket(x, BUCKETS)))).alias("word"))
    counted = cut_lineage(likely.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c")))
    common = counted.join(F.broadcast(named), "lang").unionByName(
        counted.groupBy("word").agg(F.sum("c").alias("c")).select(F.lit(None).cast("string").alias("lang"), "word", "c", F.lit(total).cast("bigint").alias("m")))
    common = common.filter(F.col("c") * many >= F.col("m")).select("lang", F.struct((F.col("c") / F.col("m")).alias("share"), "word").alias("w"))
    # at most 500 words a reference
    listed = common.groupBy("lang").agg(F.sort_array(F.collect_list("w"), asc=False).alias("top")).withColumnRenamed("lang", "of")
    out = refs.join(listed, F.col("lang").eqNullSafe(F.col("of")), "left")
    out = out.withColumn("top", F.coalesce("top", F.array().cast("array<struct<share:double,word:string>>")))

    def added(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, x: a + x["share"])

    own = F.filter("top", lambda x: x["share"] >= OWN_SHARE)
    taken = F.transform("top", lambda x: _bucket(x["word"], SLOTS))
    return out.select(
        "lang", F.transform("top", lambda x: x["word"]).alias("words"), F.size(own).alias("n_own"),
        _bit_map(taken, SLOTS).alias("slots"),
        F.concat(F.array(1 - added(F.col("top")), added(F.filter("top", lambda x: x["share"] < OWN_SHARE))), F.transform(own, lambda x: x["share"])).alias("shares"))


def _with_reference(rows: DataFrame, refs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the named columns of a row's language, or else of the whole corpus (one row); at most 1,001 rows are broadcast."""
    packed = F.struct(*names)
    mine = refs.filter("lang is not null").select("lang", packed.alias("mine"))
    whole = refs.filter("lang is null").select(F.lit(1).alias("one"), packed.alias("whole"))
    out = rows.withColumn("one", F.lit(1)).join(F.broadcast(mine), "lang", "left").join(F.broadcast(whole), "one", "left")
    return once(out, ref=F.coalesce("mine", "whole")).select(*rows.columns, *[F.col("ref")[n].alias(n) for n in names])


def _counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, lang and all counts of a text, with the distance of its words), (shares of the classes by lang)."""
    refs = cut_lineage(word_references(rows))
    out = _with_reference(rows, refs, ["words", "n_own", "slots", "shares"])
    first, second, third, repeated = repeated_words("w")
    out = once(out, w=words_of(F.col("text")), n=F.length("text"), rest=F.regexp_replace("text", r"[a-z\x20\x09]+", ""),
               lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = once(out, n_words=F.size("w").cast("bigint"), word_chars=F.length(F.array_join("w", "")), known=F.filter("w", lambda x: F.get("slots", _bucket(x, SLOTS))),
               n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"), **first)
    out = once(out, classes=class_counts(F.col("n"), F.col("word_chars"), F.col("rest")),
               # places of common words, those beyond the words of their own as -1; 0 is a word that shares a slot
               common=F.array_remove(F.transform("known", lambda x: F.array_position("words", x)), 0))
    out = out.select("row", "lang", "n", "classes", "n_words", "word_chars", "n_dup_lines", "n_own", "shares", "window",
                     F.transform("common", lambda x: F.when(x > F.col("n_own"), F.lit(-1).cast("bigint")).otherwise(x)).alias("common"))
    out = once(once(out, **second), **third)
    met = F.transform(F.array_distinct("common"), lambda x: F.struct(
        F.get("shares", F.when(x < 0, F.lit(1)).otherwise(x + 1).cast("int")).alias("q"),
        F.try_divide(F.size("common") - F.size(F.array_remove("common", x)), F.col("n_words")).alias("p")))
    out = once(out, met=met, others=F.struct(F.get("shares", F.lit(0)).alias("q"), F.try_divide(F.col("n_words") - F.size("common"), F.col("n_words")).alias("p")))
    # a bin that the text lacks adds q * ln 2
    seen = F.aggregate("met", F.lit(0.0), lambda a, x: a + divergence_term(x["p"], x["q"])) + divergence_term(F.col("others.p"), F.col("others.q"))
    absent = 1 - F.aggregate("met", F.lit(0.0), lambda a, x: a + x["q"]) - F.col("others.q")
    out = cut_lineage(out.select(
        "row", "lang", "n", "classes", "n_words", "word_chars", "n_dup_lines", repeated.alias("n_repeat_words"),
        F.when(F.col("n_words") >= MIN_WORDS, distance(seen + absent * F.log(F.lit(2.0)))).alias("word_distance")))
    size = len(CLASSES) + 3
    sums = out.groupBy("lang").agg(F.array(*[F.sum(F.get("classes", F.lit(i))) for i in range(size)]).alias("c"))
    named = sums.join(F.broadcast(refs.filter("lang is not null").select("lang")), "lang")
    whole = out.agg(F.array(*[F.sum(F.get("classes", F.lit(i))) for i in range(size)]).alias("c")).select(F.lit(None).cast("string").alias("lang"), "c")
    every = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out, named.unionByName(whole).select("lang", F.transform("c", lambda x: F.try_divide(x, every)).alias("chars"))


def judged(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns and ``RESULTS`` of every row; ``docs`` has text and lang."""
    named = without(docs.select(*[col(k) for k in keep]), *RESULTS)
    rows = docs.select(F.struct(F.lit(0).alias("no"), *[col(c) for c in named.columns]).alias("row"), col("lang").cast("string").alias("lang"),
                       F.coalesce(col("text").cast("string"), F.lit("")).alias("text"))
    out, refs = _counted(rows)
    out = _with_reference(out, refs, ["chars"])
    shares = F.zip_with("classes", "chars", lambda c, q: divergence_term(F.try_divide(c, F.col("n")), q))
    out = once(out, char_distance=F.when(F.col("n") >= MIN_CHARS, distance(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))

    def beyond(name: str, limit: float, noise: float, size: str) -> Column:
        return F.coalesce(F.col(name) > limit + F.try_divide(F.lit(noise), F.sqrt(size)), F.lit(False))

    far = beyond("char_distance", CHAR_LIMIT, CHAR_NOISE, "n") | beyond("word_distance", WORD_LIMIT, WORD_NOISE, "n_words")
    return out.select(
        *[F.col("row")[c].alias(c) for c in named.columns], "n_words", F.col("word_chars").cast("bigint").alias("word_chars"),
        F.get("classes", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "base_failed",
        "char_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"))
