"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash of 48 bits.  A source's documents with a hash up to a threshold enter the mix once more.  The
threshold that meets the source's word budget is found without sorting: words are summed by source and hash bucket, the
bucket in which the budget runs out is looked up in the running total of at most 4,096 buckets, and only the documents
of that one bucket are summed again by finer buckets, until a bucket is a single hash.  The thresholds of a source are
nested: whoever is in the mix twice is in it once as well.  Where the budget runs out among rows that share a hash, as many
of them are taken once more as come nearest to it.

Defined cases: a null text has 0 words; a null source is a source of its own, the last in order; null or repeated ids
are told apart by their texts; rows that repeat both id and text share a hash, and at the threshold some of them may be
taken once more than others; an empty table gives an empty mix; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faqloom.llm.common import join_dimension, word_count
from faqloom.session import materialize

LEVELS = 4
BITS = 12
#: Sources that one task may number.
RANKED = 100_000
#: Equal rows that one row is turned back into at a time.
EQUAL_ROWS = 10_000


def mix_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of the MD5 of id and text."""
    blank = F.lit("")
    seed = F.concat(F.coalesce(doc_id.cast("string"), blank), F.lit(":"), F.md5(F.coalesce(text, blank)))
    return F.conv(F.substring(F.md5(seed), 1, LEVELS * BITS // 4), 16, 10).cast("bigint")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts null last: 0 and the source, or 1."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: doc_id, key (of its source), size, h."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        source_key(F.col(source)).alias("key"),
        word_count(F.col(text)).alias("size"),
        mix_hash(F.col(doc_id), F.col(text)).alias("h"),
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2
) -> DataFrame:
    """Per source (key): source_size, weight and target.

    The sources, numbered by code point, weigh ``weights`` in turn and share ``share`` (a fraction) of all words.  A
    target stops at ``most`` times the source's words; the excess goes to the others by weight, round by round, until
    none is above.  Each round is one small aggregate.
    """
    totals = materialize(sizes.groupBy("key").agg(F.sum("size").alias("source_size")), "mix-sources")
    # numbered in order: ranges of keys, each by itself, then offset by the rows of the ranges ahead
    parts = 1 + totals.count() // RANKED
    ranges = totals.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges, "mix-ranges")
    ahead = {r[0]: r[1] for r in ranges.groupBy("part").count().collect()}
    offsets = [sum(n for p, n in ahead.items() if p < part) for part in range(parts)]
    place = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1 + F.get(
        F.array(*[F.lit(n) for n in offsets]), F.col("part")
    )
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = materialize(
        ranges.select("key", "source_size", F.get(turn, (place % len(weights)).cast("int")).alias("weight")), "mix-weights"
    )
    cap = F.col("source_size") * most
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    # a level of words per weight; sources whose cap lies below it are full
    full_words, open_weight, level = 0, None, None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        row = ranked.agg(
            F.sum(F.when(full, cap).otherwise(0)).alias("words"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w")
        ).first()
        if not row["w"] or (full_words, open_weight) == (row["words"], row["w"]):
            break
        full_words, open_weight = row["words"], row["w"]
        level = (whole * share[0] / share[1] - full_words) / open_weight
    level = 0.0 if level is None else level
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))
    return ranked.select("key", "source_size", "weight", F.greatest(target, F.lit(0.0)).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``copies`` that every document gets, the hash ``last`` up to which documents get one more (-1: none), and
    ``edge``, the hash after it if the budget runs out there, of whose rows ``edge_rows`` get one more."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    budgets = targets.withColumn("copies", copies).withColumn(
        "budget", F.col("target") - F.col("copies") * F.col("source_size")
    )
    level = materialize(
        budgets.select("key", "source_size", "target", "copies", "budget", F.lit(0).cast("bigint").alias("prefix")),
        "mix-level",
    )
    for step in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - step)
        inside = sizes.withColumn("prefix", F.shiftright("h", shift + BITS))
        rows = join_dimension(inside, level.select("key", "prefix"), ["key", "prefix"])
        buckets = rows.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        order = Window.partitionBy("key").orderBy("bucket")
        buckets = buckets.withColumn("upto", F.sum("words").over(order))
        joined = buckets.join(level.drop("prefix"), "key")
        left = F.col("budget") - (F.col("upto") - F.col("words"))
        found = joined.filter((left >= 0) & (F.col("budget") < F.col("upto")))
        if step < LEVELS:
            edge = F.lit(None).cast("bigint")
            found = found.select("key", F.col("bucket").alias("prefix"), left.alias("budget"), edge.alias("edge"), edge.alias("edge_rows"))
        else:  # one hash: as many of its rows as come nearest to the budget
            nearest = F.ceil(left * F.col("n") / F.col("words") - 0.5).cast("bigint")
            found = found.select("key", (F.col("bucket") - 1).alias("prefix"), left.alias("budget"), F.col("bucket").alias("edge"),
                                 F.greatest(nearest, F.lit(0).cast("bigint")).alias("edge_rows"))
        level = level.drop("prefix", "budget", "edge", "edge_rows").join(found, "key", "left")
        # a budget that no bucket exceeds takes all there is: the last prefix of the level
        everything = F.lit((1 << (BITS * step)) - 1)
        level = level.withColumn("prefix", F.coalesce("prefix", everything)).withColumn(
            "budget", F.coalesce("budget", F.lit(float("inf")))
        )
        level = materialize(level, "mix-level")
    return level.select("key", "source_size", "target", "copies", F.col("prefix").alias("last"), "edge", "edge_rows")


def taken_by(sizes: DataFrame, plan: DataFrame, copies: str = "copies") -> DataFrame:
    """Add source_size, target and the number of copies to rows with key, size and h.

    Equal rows at a threshold are brought to one row with their number, so that any number of them is split at once.
    """
    plan = plan.select("key", "source_size", "target", F.col("copies").alias("_all"), "last", "edge", "edge_rows")
    joined = join_dimension(sizes, plan, ["key"])
    here = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    own = [*sizes.columns, "source_size", "target"]
    plain = joined.filter(~here).select(*own, (F.col("_all") + (F.col("h") <= F.col("last")).cast("int")).alias(copies))
    equal = joined.filter(here).groupBy(*joined.columns).agg(F.count("*").alias("_n"))
    order = Window.partitionBy("key", "h").orderBy("size", F.xxhash64(*sizes.columns)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("edge_rows") - F.coalesce(F.sum("_n").over(order), F.lit(0))
    more = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("_n"), left))
    split = equal.withColumn("_more", more).withColumn("_part", F.explode(F.array(
        F.struct(F.lit(1).alias("one"), F.col("_more").alias("n")), F.struct(F.lit(0).alias("one"), (F.col("_n") - F.col("_more")).alias("n")))))
    split = split.filter("_part.n > 0").withColumn("_at", F.explode(F.expr(f"sequence(0, (_part.n - 1) div {EQUAL_ROWS})")))
    split = split.repartition(split.sparkSession.sparkContext.defaultParallelism, "h", "_part", "_at")
    rows = split.withColumn("_i", F.explode(F.expr(f"sequence(1, least({EQUAL_ROWS}, _part.n - _at * {EQUAL_ROWS}))")))
    return plain.unionByName(rows.select(*own, (F.col("_all") + F.col("_part.one")).alias(copies)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sizes = materialize(measured(docs), "mix-sizes")
    plan = thresholds(sizes, source_targets(sizes, **options))
    return taken_by(sizes, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole, each once, with size, source_size, target, copies and taken; columns of these
    names that are there already give way."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source")
    sizes = materialize(measured(docs), "mix-sizes")
    plan = thresholds(sizes, source_targets(sizes, **options))
    rows = packed.select(
        "_row",
        source_key(F.col("source")).alias("key"),
        word_count(F.col("text")).alias("size"),
        mix_hash(F.col("doc_id"), F.col("text")).alias("h"),
    )
    added = ["size", "source_size", "target", "copies", "taken"]
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in added]
    out = taken_by(rows, plan).withColumn("taken", F.col("copies") * F.col("size"))
    return out.filter("copies > 0").select(*kept, *added)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
k AS (  -- sources by the level at which they are full, each with what is full below and the weight still open
  SELECT *, 2 * source_size / w AS full_at,
    coalesce(sum(2 * source_size) OVER o, 0) AS below, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open
  FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT (((SELECT sum(source_size) FROM s) * 3 / 2)::DOUBLE - below::DOUBLE) / open::DOUBLE AS level
  FROM k QUALIFY row_number() OVER (ORDER BY CASE WHEN level <= full_at THEN 0 ELSE 1 END, full_at) = 1),
t AS (
  SELECT source, source_size, least(2.0 * source_size, w * level)::DOUBLE AS target FROM s, l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies,
    target - copies * source_size AS budget FROM t),
r AS (
  SELECT d.*, b.source_size, b.target, b.copies, b.budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS own,
    count(*) OVER (PARTITION BY d.source, h) AS n, row_number() OVER (PARTITION BY d.source, h ORDER BY size, doc_id) AS place
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN budget >= upto THEN 1 WHEN budget < upto - own THEN 0
    WHEN place <= ceil((budget - (upto - own)) * n / own - 0.5) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
