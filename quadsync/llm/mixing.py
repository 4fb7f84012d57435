"""Operator 4: mixing sources to target weights (DataFrame functions only).

Words are counted per source, every source gets a target by weight, and each
document is taken ``floor(rate)`` times plus once more with probability
``rate - floor(rate)``, decided by a hash of its id (``rate = target / size of
the source``), so reruns agree.

Weights go to the sources in code-point order (a null source is one and comes
last), repeating.  All targets together are as large as all sources; a target
stops at ``cap`` times its source, and what it leaves is shared again by weight.
That is one level ``x`` with ``target = min(cap * size, x * weight)``, found by
running sums over the sources in the order in which they fill up.

Cases: a null text has size 0; a source without words keeps its documents once
(rate 1, they weigh nothing); rows with equal ids get equal decisions; a null
id counts as the text ``null``.  Only the sums per source meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def hash_unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) from 52 bits of md5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, target)."""
    lcm = math.lcm(*weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fills = Window.orderBy("fill", "place")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    onward = fills.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("place", F.row_number().over(by_name) - 1)
              .withColumn("weight", w)
              .withColumn("most", F.col("source_size") * cap)
              .withColumn("fill", F.col("most") * (F.lit(lcm) / F.col("weight")).cast("long")))
    level = (ranked
             .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
             .withColumn("share", F.sum("weight").over(onward))
             .withColumn("full", F.col("most") * F.col("share") <= F.col("left") * F.col("weight")))
    open_at = F.first(F.when(~F.col("full"), F.struct("left", "share")), ignorenulls=True).over(every)
    return (level.withColumn("at", open_at)
            .withColumn("target", F.when(F.col("full"), F.col("most").cast("double"))
                        .otherwise(F.col("at.left").cast("double") * F.col("weight") / F.col("at.share")))
            .select("source", "source_size", "target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``keep`` columns as struct ``row``, size, source_size, target, rate, copies."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
                        *([F.struct(*keep).alias("row")] if keep else []))
    sizes = (docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
             .groupBy("source").agg(F.sum("size").alias("source_size")))
    t = source_targets(sizes, weights, cap).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.floor("rate")
    extra = (hash_unit(seed, F.col("doc_id")) < F.col("rate") - whole).cast("long")
    return (sized.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .withColumn("rate", rate).withColumn("copies", whole.cast("long") + extra))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document's row comes as often as it is taken."""
    m = mix_sources(docs, keep=tuple(f"`{c}`" for c in docs.columns))
    rows = m.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_mixing(spark, sf_dir):
    from quadsync.llm.shared import table

    m = mix_sources(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, 3 * source_size AS most,
         3 * source_size * CASE place % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 10 END AS fill FROM s),
l AS (
  SELECT *, (SELECT sum(source_size) FROM s)::BIGINT
            - coalesce(sum(most) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
         sum(weight) OVER (ORDER BY fill, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS share FROM w),
f AS (SELECT *, most * share <= rest * weight AS is_full FROM l),
o AS (SELECT rest, share FROM f WHERE NOT is_full ORDER BY fill, place LIMIT 1),
t AS (
  SELECT f.source, f.source_size,
         CASE WHEN is_full THEN most::DOUBLE ELSE o.rest::DOUBLE * weight / o.share END AS target
  FROM f LEFT JOIN o ON true),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE
         / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM c
"""
