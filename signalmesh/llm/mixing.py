"""Operator 10: mixing sources to target weights by capped water-filling.

DataFrame functions only.  Weights share a budget of words; a source's target
stops at ``max_epochs`` times its size, and what it cannot take goes to the
others by weight until none is above.  In the order of cap / weight this has a
closed form: a source is clamped when its cap lies below the level that all
sources before it leave, so a running sum over the (aggregated) sources finds
the level at once.

Documents are repeated whole: a source with target / size = 1.3 takes every
document once and a seeded sample of 0.3 of its words again.  The sample is
systematic, so that taken words come near the target whatever the sizes: in a
seeded order within size tiers (documents above 1/8, 1/64, 1/512 of the source,
at most 584 a source) each is taken if that keeps what is taken nearest to the
wanted share of what was seen; the many below that are taken in seeded order up
to what is left.  That prefix is found in two steps, so that a source holding a
third of all rows needs no single task: sums of 4096 seeded buckets tell
the one bucket where it ends, and only its rows are ordered.

Defined results: null text has size 0 and is taken 0 times; sources without
words have target 0; a null source is a source of its own, the last; repeated
rows are separate documents of equal size; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmesh.llm.common import RID, SPACE, numbered, table, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MAX_EPOCHS, SEED = 1.5, 2.0, 17
#: Size tiers: shares of the source, as divisors.
TIERS = (8, 64, 512)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    return (sizes.withColumn("weight", weight)
            .withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("budget", F.least(F.sum("source_size").over(everything) * share, F.sum("cap").over(everything)))
            .withColumn("all_weight", F.sum("weight").over(everything))
            .withColumn("cap_before", F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
            .withColumn("weight_before", F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
            .withColumn("clamped", F.col("cap") * (F.col("all_weight") - F.col("weight_before"))
                        <= F.col("weight") * (F.col("budget") - F.col("cap_before")))
            .withColumn("free", F.col("budget") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything))
            .withColumn("free_weight", F.col("all_weight")
                        - F.sum(F.when(F.col("clamped"), F.col("weight")).otherwise(0.0)).over(everything))
            .select("source", "source_size", F.when(F.col("clamped"), F.col("cap"))
                    .otherwise(F.col("free") * F.col("weight") / F.col("free_weight")).alias("target")))


def _sampled_large(large: DataFrame) -> DataFrame:
    """At most 584 rows a source: a fold that takes a document when that keeps the taken words nearest to their share."""
    entries = F.array_sort(F.collect_list(F.struct("tier", "place", RID, "doc_id", "size")))
    zero = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("got"),
                    F.array().cast("array<boolean>").alias("takes"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["size"]
        take = acc["got"] + x["size"] / 2 <= F.col("fraction") * seen
        return F.struct(seen.alias("seen"), (acc["got"] + F.when(take, x["size"]).otherwise(F.lit(0).cast("long"))).alias("got"),
                        F.concat(acc["takes"], F.array(take)).alias("takes"))

    return (large.groupBy("source", "source_size", "target", "whole", "fraction").agg(entries.alias("entries"))
            .withColumn("fold", F.aggregate("entries", zero, step))
            .select("source", "source_size", "target", "whole", "fraction", F.col("fold.got").alias("got"),
                    F.explode(F.arrays_zip(F.col("entries").alias("e"), F.col("fold.takes").alias("take"))).alias("x")))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
        seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        has_rid: bool = False) -> DataFrame:
    """One row per input row (``has_rid``: numbered before): row number, ``doc_id, size, source_size, target, taken`` and ``copies`` (taken / size)."""
    rid = F.col(RID) if has_rid else F.monotonically_increasing_id().alias(RID)
    rows = written(docs.select(rid, F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                               words(F.col(text)).alias("size"))
                   .withColumn("place", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)),
                   "mix-rows")
    plan = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
                   .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
                   .withColumn("whole", F.floor("rate")).withColumn("fraction", F.col("rate") - F.col("whole")), "mix-plan")
    tier = F.coalesce(*[F.when(F.col("size") * d > F.col("source_size"), F.lit(k)) for k, d in enumerate(TIERS)], F.lit(len(TIERS)))
    dealt = rows.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s").withColumn("tier", tier)
    out = ["doc_id", "size", "source_size", "target"]
    copies = lambda take: (F.col("whole") + F.when(take, 1).otherwise(0)).cast("int").alias("copies")

    large = written(_sampled_large(dealt.filter(F.col("tier") < len(TIERS))), "mix-large")
    from_large = large.select(F.col(f"x.e.{RID}").alias(RID), F.col("x.e.doc_id").alias("doc_id"), F.col("x.e.size").alias("size"),
                              "source_size", "target", copies(F.col("x.take")))
    got = large.groupBy("source").agg(F.max("got").alias("got"))
    left = plan.withColumnRenamed("source", "s").join(got, F.col("s").eqNullSafe(F.col("source")), "left").select(
        F.col("s").alias("source"), (F.col("fraction") * F.col("source_size") - F.coalesce(F.col("got"), F.lit(0))).alias("left"))

    small = dealt.filter(F.col("tier") == len(TIERS)).withColumn("bucket", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    through = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (small.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
               .withColumn("before", F.sum("in_bucket").over(through) - F.col("in_bucket"))
               .withColumnRenamed("source", "s").join(left, F.col("s").eqNullSafe(F.col("source"))).drop("source"))
    #: All of a bucket, none of it, or (at most one bucket a source) a part of it.
    state = (F.when(F.col("before") + F.col("in_bucket") <= F.col("left"), F.lit(1))
             .when(F.col("before") >= F.col("left"), F.lit(0)).otherwise(F.lit(2)))
    buckets = written(buckets.select("s", F.col("bucket").alias("b"), "before", "left", state.alias("state")), "mix-buckets")
    placed = small.join(buckets, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("bucket")))
    plain = placed.filter("state < 2").select(RID, *out, copies(F.col("state") == 1))
    in_order = Window.partitionBy("source").orderBy("place", RID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partial = (placed.filter("state = 2").withColumn("through", F.col("before") + F.sum("size").over(in_order))
               .select(RID, *out, copies(F.col("through") - F.col("size") / 2 <= F.col("left"))))
    return (from_large.unionByName(plain).unionByName(partial)
            .select(RID, *out, (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies"))


def repeat_rows(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    columns = docs.columns
    docs = numbered(docs)
    taken = mix(docs, has_rid=True, **how).filter("taken > 0").select(RID, F.col("copies").alias("__copies"))
    return (docs.join(taken, RID).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each of all ``documents``."""
    return mix(table(spark, sf_dir, "documents")).drop(RID, "copies")


#: The same in DuckDB, in plain running sums and a recursive walk of each source's large documents.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         sha256('17:' || doc_id) AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
c AS (SELECT *, least(sum(source_size) OVER () * 1.5::DOUBLE, sum(cap) OVER ()) AS budget, sum(weight) OVER () AS all_weight,
             coalesce(sum(cap) OVER f, 0) AS cap_before, coalesce(sum(weight) OVER f, 0) AS weight_before
      FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, cap * (all_weight - weight_before) <= weight * (budget - cap_before) AS clamped FROM c),
t AS (SELECT source, source_size,
             CASE WHEN clamped THEN cap ELSE (budget - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) * weight
                  / (all_weight - sum(CASE WHEN clamped THEN weight ELSE 0 END) OVER ()) END AS target FROM k),
p AS (SELECT *, floor(rate) AS whole, rate - floor(rate) AS fraction
      FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)),
r AS (SELECT d.doc_id, d.size, d.place, p.*,
             CASE WHEN size * 8 > source_size THEN 0 WHEN size * 64 > source_size THEN 1
                  WHEN size * 512 > source_size THEN 2 ELSE 3 END AS tier
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier, place) AS rn FROM r WHERE tier < 3),
walk AS (
  SELECT source, 0::BIGINT AS rn, 0::BIGINT AS seen, 0::BIGINT AS got, false AS take FROM p
  UNION ALL
  SELECT l.source, l.rn, walk.seen + l.size,
         walk.got + CASE WHEN walk.got + l.size / 2.0::DOUBLE <= l.fraction * (walk.seen + l.size) THEN l.size ELSE 0 END,
         walk.got + l.size / 2.0::DOUBLE <= l.fraction * (walk.seen + l.size)
  FROM walk JOIN l ON l.source IS NOT DISTINCT FROM walk.source AND l.rn = walk.rn + 1),
g AS (SELECT source, max(got) AS got FROM walk GROUP BY source),
small AS (SELECT r.*, sum(size) OVER (PARTITION BY r.source ORDER BY place ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE
                      <= fraction * source_size - got AS take
          FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE tier = 3)
SELECT doc_id, size, source_size, target, (size * (whole + take::INT))::BIGINT AS taken
FROM l JOIN (SELECT source AS ws, rn AS wrn, take FROM walk) ON ws IS NOT DISTINCT FROM source AND wrn = rn
UNION ALL
SELECT doc_id, size, source_size, target, (size * (whole + take::INT))::BIGINT FROM small
"""
