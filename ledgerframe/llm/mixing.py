"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words, and every document an importance: the expected copies of a source's documents are in
proportion to it, up to ``MOST`` copies each, at the level at which they add up to the target. Without a column for it, the
importance of a document is the number of binary digits of its size, so longer documents are likelier but not overwhelming.
A document first gets the whole copies that are certain; for the rest each has its own inclusion probability p, and documents
are ranked by the Pareto order ``(u / (1 - u)) / (p / (1 - p))`` with u a fixed random number of the document. Taking documents
in this order up to a fixed size is sampling with unequal probabilities and a size that does not vary between draws.
The size is counted in words: the sample ends at the document that brings the source nearest to its target.

No source is ordered in one task: ranks are cut into slices of equal probability, word counts of the slices are summed,
and only the documents of the slice that holds the cut are put in order; slices that are still large are cut again.

Defined results: a null text has size 0 and is never taken; null sources are one source, after all others; an equal u
(repeated rows) is ordered by doc_id, size and then arbitrarily among equal rows; a source without words has target 0;
documents with a null importance or one that is not positive are never taken, and a source whose others cannot reach the target
at ``MOST`` copies each stays below it; an empty table gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import put, shielded, text_or_empty
from .storage import discard, materialize

#: Weights dealt to the sources by code point order, null last, and repeated.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input, and the most copies of a source.
SHARE, MOST = 1.5, 2
#: Slices of a source, and the documents that may be put in order at once.
SLICES, ORDERED = 1 << 12, 20_000
#: A given importance is taken to the nearest of so many levels an octave, so a source has a bounded number of them.
LEVELS = 16
_RANKS = 1 << 52
_NO_ID = -(1 << 63)


def size_in_words() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def random_number() -> Column:
    """52 fixed random bits of the document's id as a long."""
    key = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all words dealt by weight; a source stops at ``most`` times its own
    words and what it cannot take is dealt to the others by weight. One row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    # sources fill up in the order of cap / weight; the level is that of the first source that fits below its cap
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    earlier, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumns({"full": F.coalesce(F.sum("cap").over(earlier), F.lit(0)), "gone": F.coalesce(F.sum("w").over(earlier), F.lit(0)), "words": F.sum("source_size").over(whole), "ws": F.sum("w").over(whole)})
    per = per.withColumn("level", (F.lit(share) * F.col("words") - F.col("full")) / (F.col("ws") - F.col("gone")))
    fits = F.first(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), F.coalesce(fits, F.lit(float("inf"))) * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def _pareto_rank(u: Column, p: Column) -> Column:
    """Odds of u over odds of p, mapped from (0, inf) to 52 bits: x / (1 + x) keeps the order."""
    a, b = u * (F.lit(1.0) - p), p * (F.lit(1.0) - u)
    return F.floor(F.when(a + b > 0, a / (a + b)).otherwise(F.lit(1.0)) * F.lit(float(_RANKS))).cast("long")


def _levels(importance: str | None) -> Column:
    """The importance as one of a bounded number of levels; null where a document is never to be taken."""
    if importance is None:
        return F.when(F.col("size") > 0, F.length(F.bin("size"))).cast("double")
    given = F.col(importance).cast("double")
    given = F.when((given > 0) & (given < float("inf")), F.greatest(F.lit(1e-300), given))
    return F.pow(F.lit(2.0), F.round(F.log2(given) * LEVELS) / LEVELS)


def slopes(sized: DataFrame, goal: DataFrame, most: int) -> DataFrame:
    """(source, slope): copies expected for an importance of 1, so that ``min(most, slope x importance)`` copies of each
    document make the target; null where all must be taken ``most`` times. ``sized`` has source, size and _each."""
    levels = sized.filter("size > 0 and _each is not null").groupBy("source", "_each").agg(F.sum("size").alias("mass"))
    levels = levels.join(goal.select("_source", "_target"), F.col("source").eqNullSafe(F.col("_source")))
    down = Window.partitionBy("source").orderBy(F.col("_each").desc())
    full = F.coalesce(F.sum("mass").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("mass") * F.col("_each")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = levels.withColumn("slope", (F.col("_target") - F.lit(most) * full) / rest)
    # the documents above a level are taken `most` times each; the first level that stays below that
    fits = F.max_by(F.when(F.col("slope") * F.col("_each") <= most, F.col("slope")), F.when(F.col("slope") * F.col("_each") <= most, F.col("_each")))
    return levels.groupBy("source").agg(fits.alias("slope"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, importance: str | None = None, slices: int = SLICES, ordered: int = ORDERED) -> DataFrame:
    """``docs`` with size, source_size, target, copies (whole copies the mix takes, at most ``most``) and taken.

    ``importance`` names a column of positive numbers to which the expected copies within a source are in proportion."""
    sized = put(docs, size=size_in_words(), _u=random_number() / F.lit(float(_RANKS)))
    sized = sized.withColumn("_each", _levels(importance))
    goal = targets(sized.select("source", "size"), weights, share, most).withColumnRenamed("source", "_source").withColumnsRenamed({"source_size": "_source_size", "target": "_target"})
    goal = materialize(goal, "targets")
    by = slopes(sized.select("source", "size", "_each"), goal, most).select(F.col("source").alias("_source2"), F.coalesce("slope", F.lit(float("inf"))).alias("_slope"))
    level = materialize(goal.join(by, F.col("_source").eqNullSafe(F.col("_source2")), "left").drop("_source2"), "slopes")
    expected = F.when(F.col("_each").isNotNull() & (F.col("_target") > 0), F.least(F.lit(float(most)), F.col("_slope") * F.col("_each"))).otherwise(0.0)
    out = sized.join(level, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_expected", expected)
    out = out.withColumn("_whole", F.when(F.col("size") > 0, F.floor("_expected")).otherwise(0).cast("long")).withColumn("_rank", _pareto_rank(F.col("_u"), F.col("_expected") - F.col("_whole")))
    units = materialize(out.filter("size > 0 and _each is not null").select(F.col("source").alias("s"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "size", "_whole", "_rank", (F.col("_whole") < most).alias("open")), "units")
    cuts = materialize(_cuts(units, goal, slices, ordered), "cuts")
    discard(units)
    out = out.join(cuts, F.col("source").eqNullSafe(F.col("_cut_source")), "left")
    key = F.struct(F.col("_rank").alias("a"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("b"), F.col("size").alias("c"))
    cut = F.struct(F.col("_cut_rank").alias("a"), F.col("_cut_id").alias("b"), F.col("_cut_size").alias("c"))
    extra = F.when(F.col("_cut_rank").isNotNull() & F.col("_each").isNotNull() & (F.col("_whole") < most) & (key <= cut), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("_whole") + extra).otherwise(0).cast("long")
    return put(out, size=F.col("size"), source_size=F.col("_source_size"), target=F.col("_target"), copies=copies, taken=copies * F.col("size")).drop("_each", "_u", "_source", "_source_size", "_target", "_slope", "_expected", "_whole", "_rank", "_cut_source", "_cut_rank", "_cut_id", "_cut_size")


def _cuts(units: DataFrame, goal: DataFrame, slices: int, ordered: int) -> DataFrame:
    """For each source the last unit (rank, id, size) of its sample, so that whole copies and sample come nearest to the
    target. A slice is a range of ranks; ``lo`` and ``hi`` bound the one that holds the cut and ``before`` counts the
    words below it. Every turn divides it until it holds at most ``ordered`` units or one rank."""
    certain = units.groupBy("s").agg(F.sum(F.col("size") * F.col("_whole")).alias("sure")).withColumnRenamed("s", "_s")
    at = goal.join(certain, F.col("_source").eqNullSafe(F.col("_s"))).select(F.col("_source").alias("t"), (F.col("_target") - F.col("sure")).alias("rest"), F.lit(0).cast("long").alias("lo"), F.lit(_RANKS + 1).cast("long").alias("hi"), F.lit(0).cast("long").alias("before")).filter("rest > 0")
    units = units.filter("open")
    width = F.expr(f"greatest(1, (hi - lo + {slices - 1}) div {slices})")
    run = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        inside = units.join(at, F.col("s").eqNullSafe(F.col("t"))).filter("_rank >= lo and _rank < hi")
        cells = inside.withColumn("part", F.floor((F.col("_rank") - F.col("lo")) / width)).groupBy("s", "rest", "lo", "hi", "before", "part").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        cells = cells.withColumn("upto", F.col("before") + F.sum("words").over(run))
        reached = F.min(F.when(F.col("upto") >= F.col("rest"), F.col("part"))).over(Window.partitionBy("s"))
        cells = cells.withColumn("_at", F.coalesce(reached, F.max("part").over(Window.partitionBy("s")))).filter("part = _at")
        at = materialize(cells.select(F.col("s").alias("t"), "rest", (F.col("lo") + F.col("part") * width).alias("lo"), F.least(F.col("hi"), F.col("lo") + (F.col("part") + 1) * width).alias("hi"), (F.col("upto") - F.col("words")).alias("before"), "n"), "slices")
        if at.filter((F.col("n") > ordered) & (F.col("hi") - F.col("lo") > 1)).isEmpty():
            break
        at = at.drop("n")
    inside = units.join(at.drop("n"), F.col("s").eqNullSafe(F.col("t"))).filter("_rank >= lo and _rank < hi")
    inside = inside.groupBy("s", "rest", "before", "_rank", "id", "size").agg(F.sum("size").alias("words"))  # equal rows go together
    run = Window.partitionBy("s").orderBy("_rank", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(run))
    inside = inside.withColumn("off", F.abs(F.col("upto") - F.col("rest"))).withColumn("off0", F.abs(F.col("upto") - F.col("words") - F.col("rest")))
    best = inside.groupBy("s").agg(F.min_by(F.struct("_rank", "id", "size", "off"), F.struct("off", "_rank", "id", "size")).alias("x"), F.min(F.struct("_rank", "id", "size", "off0")).alias("first"))
    earlier = F.col("first.off0") <= F.col("x.off")  # to end before the slice is nearer
    return best.select(F.col("s").alias("_cut_source"), F.when(earlier, F.col("first._rank")).otherwise(F.col("x._rank")).alias("_cut_rank"), F.when(earlier, F.col("first.id")).otherwise(F.col("x.id")).alias("_cut_id"), F.when(earlier, F.col("first.size") - 1).otherwise(F.col("x.size")).alias("_cut_size"))


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    def copied(own: DataFrame) -> DataFrame:
        return mix(own, **options).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    return shielded(docs, copied)


def op6_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 13))::BIGINT / {float(_RANKS)!r}::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS z, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
      FROM d GROUP BY source),
f AS (SELECT *, 2 * z AS cap, ({SHARE} * sum(z) OVER () - coalesce(sum(2 * z) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level,
             row_number() OVER (ORDER BY 2 * z / w, source NULLS LAST) AS k
      FROM s WINDOW b AS (ORDER BY 2 * z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, z, least(cap, (SELECT arg_min(level, k) FROM f WHERE level * w <= cap) * w) AS target FROM f),
i AS (SELECT d.*, z, target, length(bin(size))::DOUBLE AS each FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
l AS (SELECT source, each, target, sum(size)::DOUBLE AS mass FROM i WHERE size > 0 GROUP BY ALL),
v AS (SELECT source, each, (target - 2 * coalesce(sum(mass) OVER (PARTITION BY source ORDER BY each DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(mass * each) OVER (PARTITION BY source ORDER BY each DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS slope FROM l),
y AS (SELECT source, arg_max(slope, each) FILTER (WHERE slope * each <= 2) AS slope FROM v GROUP BY source),
e AS (SELECT i.*, CASE WHEN size > 0 AND target > 0 THEN least(2.0, coalesce(slope, 'Infinity'::DOUBLE) * each) ELSE 0 END AS x
      FROM i LEFT JOIN y ON i.source IS NOT DISTINCT FROM y.source),
r AS (SELECT *, floor(x) AS whole, x - floor(x) AS p FROM e),
q AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS rest,
             floor(CASE WHEN u * (1 - p) + p * (1 - u) > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) ELSE 1 END * {float(_RANKS)!r}::DOUBLE) AS rank FROM r),
c AS (SELECT *, sum(CASE WHEN whole < 2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size) AS upto FROM q),
o AS (SELECT *, abs(upto - rest) AS off, min(CASE WHEN whole < 2 THEN abs(upto - rest) END) OVER (PARTITION BY source) AS least_off FROM c),
n AS (SELECT *, CASE WHEN rest <= 0 OR rest <= least_off THEN 0
                ELSE min(CASE WHEN off = least_off THEN upto END) OVER (PARTITION BY source) END AS words FROM o)
SELECT doc_id, size, z::BIGINT AS source_size, target,
       (size * (whole + CASE WHEN whole < 2 AND upto <= words THEN 1 ELSE 0 END))::BIGINT AS taken
FROM n
"""
