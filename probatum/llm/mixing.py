"""Mixing sources to target weights by Pareto order sampling, DataFrame functions only.

A source's target over its size is the expected number of copies of each of its documents. The whole part is taken
for certain. The rest, an inclusion probability p that differs by source, is sampled with a fixed size in words:
documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a hash of the document, and taken in that order. One that does not
fit what the target leaves is passed over, and those behind it are tried. One more document, the one that comes nearest to
the words still open, closes the gap if it makes it smaller.

No row moves to its source. A pass counts words by source and leading digits of the hash, prefix sums over these parts tell
the part in which the first document that does not fit stands, and only that part's rows are ranked. The next pass starts
behind that document with what is open then; in random order few passes are needed, since the open words fall fast. What a
pass leaves is a range of ranks and the largest size that fits in it, so that every row tells by itself whether it is taken.
Sources are broadcast while there are at most ``FEW_SOURCES``; beyond that rows are joined to them, large sources salted.

Stated cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, ordered
last; rows equal in doc_id and text are one draw, taken alike and counted each; with no words at all every target is
0; an empty table gives an empty result; other columns pass through unless they bear an output's name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.common import WORD, col, typed
from probatum.operators.grouping import attach_group, dense_index, hash_digits
from probatum.session import cut_lineage

OUTPUTS = ("size", "source_size", "target", "taken")
FEW_SOURCES = 100_000  # records that are broadcast
_END = "g"  # behind every hex digit


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """Hex digits that stand for the uniform number of a document; the same on every run."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("~")),
                                         F.md5(F.coalesce(text, F.lit("~")).cast("binary"))).cast("binary")), 1, 15)


def odds(u: Column) -> Column:
    x = (F.conv(u, 16, 10).cast("double") + 0.5) / float(16**15)
    return x / (1 - x)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """(source, source_size) to the same with ``target``, ``whole`` and ``part`` (copies for certain, and the probability).

    Sources above their limit stay there and the others share the rest by weight, round by round. A round is one
    aggregate over the sources; two sums reach the driver.
    """
    numbered = dense_index(sizes, [F.col("source").asc_nulls_last()], "number")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    caps = cut_lineage(numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * limit))
    whole, all_weights = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * share, F.sum("weight")).first()
    level, full = (whole / all_weights if all_weights else 0.0), 0
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        n, taken, free = caps.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not free:
            break
        level, full = (whole - taken) / free, n
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (caps.withColumn("target", target)
            .withColumn("whole", F.floor(rate).cast("bigint")).withColumn("part", rate - F.floor(rate))
            .select("source", "rows", "source_size", "target", "whole", "part"))


def with_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Rows with the record of their source (``source``, ``rows`` and others), null sources matching."""
    if not few:
        return attach_group(rows, sources, ["source"], "rows", "u")
    mine = sources.withColumnRenamed("source", "__s").drop("rows")
    return rows.join(F.broadcast(mine), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def _drawn(spans: str, u: str, q: str, size: str) -> Column:
    """Whether a row of this rank and size is taken: it stands in a span of ranks and fits the largest size there."""
    return F.exists(spans, lambda s: (F.struct(F.col(q), F.col(u)) > F.struct(s["q"], s["after"])) & (F.col(u) < s["before"]) & (F.col(size) <= s["most"]))


def samples(rows: DataFrame, sources: DataFrame, few: bool, digits: int) -> DataFrame:
    """(source, spans, extra): which rows (source, u, q, size) each source (source, rows, open) draws.

    ``spans`` are ranges of ranks with the largest size that is taken in them, ``extra`` is the u of the document that closes
    the gap. A pass finds, for every source that is not done, the first document in order of q that does not fit.
    """
    whole = F.array().cast("array<struct<q:double,after:string,before:string,most:double>>")
    state = cut_lineage(sources.select("source", "rows", "open", F.lit(-1.0).alias("q"), F.lit("").alias("after"), whole.alias("spans"), F.lit(False).alias("done")))
    rank = F.struct("q", "u")
    while not state.filter("not done").isEmpty():
        now = state.filter("not done").select("source", "rows", "open", F.struct(F.col("q").alias("q"), F.col("after").alias("u")).alias("from"))
        left = with_source(rows, now, few).filter((rank > F.col("from")) & (F.col("size") <= F.col("open"))).withColumn("part", F.substring("u", 1, digits))
        # q grows with u inside a source, so the leading digits of u cut the order of q into parts
        sums = left.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("open").alias("open"))
        ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = sums.withColumn("ahead", ahead).withColumn("over", F.col("ahead") + F.col("words") > F.col("open"))
        hit = cut_lineage(parts.groupBy("source").agg(
            F.min(F.when(F.col("over"), F.struct("part", "ahead"))).alias("hit"), F.sum("words").alias("words"))
            .select("source", "hit.part", "hit.ahead", "words"))
        few_rows = with_source(left.drop("rows"), hit.filter("part is not null").select("source", F.col("part").alias("hit"), "ahead", F.lit(0).cast("bigint").alias("rows")), few)
        draws = few_rows.filter("part = hit").groupBy("source", "q", "u", "ahead", "open").agg(F.sum("size").alias("words"))
        upto = F.col("ahead") + F.sum("words").over(Window.partitionBy("source").orderBy("q", "u"))
        first = (draws.withColumn("upto", upto).filter("upto > open").groupBy("source")
                 .agg(F.min(F.struct("q", "u", (F.col("upto") - F.col("words")).alias("filled"))).alias("first")))
        found = hit.select(F.col("source").alias("__s"), "words").join(
            first.select(F.col("source").alias("__f"), "first"), F.col("__s").eqNullSafe(F.col("__f")), "left").drop("__f")
        span = F.struct("q", "after", F.coalesce("first.u", F.lit(_END)).alias("before"), F.col("open").alias("most"))
        joined = state.join(found, F.col("source").eqNullSafe(F.col("__s")), "left")
        state = cut_lineage(joined.select(
            "source", "rows", (F.col("open") - F.when(F.col("done"), 0).otherwise(F.coalesce("first.filled", "words", F.lit(0)))).alias("open"),
            F.coalesce("first.q", "q").alias("q"), F.coalesce("first.u", "after").alias("after"),
            F.when(F.col("words").isNull(), F.col("spans")).otherwise(F.concat("spans", F.array(span))).alias("spans"),
            F.col("first").isNull().alias("done")))
    open_ones = state.filter("open > 0").select("source", "rows", "spans", F.col("open").alias("gap"))
    # what was passed over is larger than the gap; one of less than twice the gap makes it smaller
    over = (with_source(rows, open_ones, few).filter((F.col("size") < 2 * F.col("gap")) & ~_drawn("spans", "u", "q", "size"))
            .groupBy("source", "u", "gap").agg(F.sum("size").alias("words")).withColumn("miss", F.abs(F.col("words") - F.col("gap"))))
    extra = over.filter("miss < gap").groupBy(F.col("source").alias("__e")).agg(F.min(F.struct("miss", "u"))["u"].alias("extra"))
    return state.join(extra, F.col("source").eqNullSafe(F.col("__e")), "left").select("source", "spans", "extra")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 7) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target``, ``taken`` (words) and ``copies`` (times the document is taken)."""
    rows = typed(docs, doc_id="bigint", text="string", source="string").select(
        "source", words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u"))
    sized = cut_lineage(rows)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = cut_lineage(targets(totals, weights, share, limit))
    few = sources.count() <= FEW_SOURCES
    left = sources.filter("part > 0").select("source", "rows", (F.col("target") - F.col("whole") * F.col("source_size")).alias("open"), "part")
    ranked = cut_lineage(with_source(sized.filter("size > 0"), left.select("source", "rows", "part"), few).select(
        "source", "size", "u", (odds(F.col("u")) / (F.col("part") / (1 - F.col("part")))).alias("q")))
    drawn = samples(ranked, left.select("source", "rows", "open"), few, hash_digits(sized))
    cuts = cut_lineage(
        sources.join(drawn.withColumnRenamed("source", "__d"), F.col("source").eqNullSafe(F.col("__d")), "left")
        .select("source", "rows", "source_size", "target", F.col("whole").alias("__whole"), F.col("part").alias("__part"), F.col("spans").alias("__spans"), F.col("extra").alias("__extra")))
    packed = docs.select(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), col("source").cast("string").alias("source"),
                         words(col("text").cast("string")).alias("size"), draw(col("doc_id").cast("bigint"), col("text").cast("string"), seed).alias("u"))
    part = F.when(F.col("__part") > 0, F.col("__part"))
    tagged = with_source(packed, cuts, few).withColumn("q", odds(F.col("u")) / (part / (1 - part)))
    sampled = (F.col("size") > 0) & F.coalesce(_drawn("__spans", "u", "q", "size") | F.coalesce(F.col("u") == F.col("__extra"), F.lit(False)), F.lit(False))
    copies = F.col("__whole") + sampled.cast("bigint")
    gone = {*OUTPUTS, "copies"}
    return tagged.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in gone],
                         "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    place = {c.lower(): f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    named = plain.select(F.struct("*").alias("row"), *[F.col(place[c]).alias(c) for c in ("doc_id", "text", "source")])
    taken = mix(named, **settings)
    return (taken.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
            .select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)]))
