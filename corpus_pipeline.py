"""Cleaning and mixing of a corpus in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; ``run``
writes them as Parquet to the shared folder and reads them back as the next
stage's docs.  The columns stay those of docs, whatever they are, as long as
doc_id, text, lang and source are among them.

1. ``language``: learns from the labelled rows of the learning folds, drops
   documents in which no language can be told (null text, no letter).
2. ``lines``: lines of at least 20 characters that three documents or more hold
   stay in the largest doc_id only; n_chars follows the text.
3. ``near_duplicates``: documents that share at least 80 % of their five-word
   shingles, directly or through others, are a group; its smallest doc_id stays.
   Rows that repeat an id with another text are documents of their own.
4. ``decontaminate``: documents that hold a passage of a benchmark item go.
5. ``mix``: sources are mixed to target weights; rows come as often as taken.

Rows without id are told apart by their text; equal rows (id and text) are one
document from stage 3 on; a text of which no line is left stays as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadsync.llm import decontaminate as bench
from quadsync.llm import jaccard_join, language, line_dedup, mixing
from quadsync.llm.shared import store, table
from quadsync.session import ship_package

NEAR_WORDS = 5
NEAR_PERCENT = 80


def _row(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def _flat(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labelled = docs.select("doc_id", "text", "lang").where(language.fold(F.col("doc_id")) != 1)
    out = language.identify(docs, labelled, _row(docs), docs.schema)
    return _flat(out.where(F.col("lang_pred") != language.UND), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs).select("row", F.concat_ws("\n", "kept").alias("left"), (F.size("kept") < F.col("n_lines")).alias("cut"))
    new = {"text": F.when(F.col("cut"), F.col("left")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut"), F.char_length("left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known, tag = F.coalesce(F.col("doc_id"), F.xxhash64(F.lit("no id"), F.col("text"))), F.xxhash64("text")
    found = jaccard_join.jaccard_classes(docs.select(known.alias("doc_id"), "text", tag.alias("tag")), NEAR_WORDS, NEAR_PERCENT)
    found = found.where("root IS NOT NULL").select("root", F.struct("doc_id", "tag").alias("one"))
    best = found.groupBy("root").agg(F.min("one").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = (found.join(best.withColumnRenamed("root", "of"), F.col("root") == F.col("of")).where("one <> best")
            .select(F.col("one.doc_id").alias("id"), F.col("one.tag").alias("h1")).distinct())
    rows = docs.select(_row(docs).alias("row"), known.alias("id"), tag.alias("h1"), F.xxhash64(F.lit("text"), "text").alias("h2"))
    rows = rows.join(gone, ["id", "h1"], "left_anti")
    # rows that repeat id and text: one of each stays, the least by its JSON; the others do not move for it
    key = ["id", "h1", "h2"]
    twice = store(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "repeated")
    again = rows.join(twice, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return _flat(rows.join(twice, key, "left_anti").select("row").unionByName(again.select("row")), docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.xxhash64("doc_id", "text")
    found = bench.contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias("gone")).distinct()
    return _flat(docs.select(_row(docs).alias("row"), key.alias("gone")).join(gone, "gone", "left_anti"), docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
]

#: Components and the learned language have no plain SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
