"""Operator 7: line dedup by levelled sorted runs (DataFrame functions only).

``LineRuns`` keeps what is known of every line as runs in the shared folder:
(h1, h2, n, holder), sorted by the 128-bit hash of the line's key, with the
number of documents and the largest id that hold it.  A batch of documents is
merge-anti-joined with the runs (what is left is new), its own sums are added
as a run of level 0, and ``FANOUT`` runs of a level are compacted to one of the
next.  After the last batch the runs are compacted once more and give the lines
to drop.

Rule: a line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends
with A-Z lower-cased; keys of at least ``MIN_CHARS`` code points found in at
least ``MIN_DOCS`` documents lose all lines except in the largest id.

Cases: null and empty texts are one empty line; equal rows (same id and text)
are one document; of several texts under the largest id all keep their lines; a
null id is smaller than all others.  Only hashes, counts and positions are
exploded, the text moves once, to meet the positions to drop.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadsync.llm.shared import drop_dir, fresh_dir, store, table

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
SPACE = " \t\n\x0b\x0c\r"
RUN = "h1 long, h2 long, n long, holder long"


def line_key(line: Column) -> Column:
    k = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(k) == F.char_length(k)
    return F.when(ascii_only, F.lower(k)).otherwise(F.translate(k, ascii_uppercase, ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of the lines with long keys; docs: doc_id, text."""
    lines = (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
             .where(F.char_length("line") >= min_chars)
             .withColumn("line", line_key(F.col("line")))
             .where(F.char_length("line") >= min_chars))
    return lines.select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def sums(keys: DataFrame) -> DataFrame:
    """What one batch knows of its lines; equal rows of a document count once."""
    per_doc = keys.groupBy("h1", "h2", "doc_id", "text_hash").agg(F.lit(1).alias("one"))
    return per_doc.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc_id").alias("holder"))


class LineRuns:
    """Levels of sorted runs below one folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.dir, self.made = spark, fanout, fresh_dir(spark, "line-runs"), 0
        self.levels: list[list[str]] = [[]]

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.dir}/{name}"
        df.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (with h1, h2) whose line no run knows."""
        return reduce(lambda left, p: left.join(self.read([p]).select("h1", "h2"), ["h1", "h2"], "left_anti"), sum(self.levels, []), batch)

    def add(self, keys: DataFrame) -> None:
        """Take a batch of ``keyed_lines``: its new lines make a run; for known
        lines only their counts are added, beside it."""
        own = store(sums(keys), "batch-sums")
        paths = sum(self.levels, [])
        run = f"{self.dir}/run-{self.made}"
        self.made += 1
        self.fresh(own).select("h1", "h2", "n", "holder").sortWithinPartitions("h1", "h2").write.parquet(run)
        if paths:
            known = own.join(self.read(paths).select("h1", "h2"), ["h1", "h2"], "left_semi")
            known.select("h1", "h2", "n", "holder").sortWithinPartitions("h1", "h2").write.mode("append").parquet(run)
        self.levels[0].append(run)
        self.compact()

    def compact(self, to_one: bool = False) -> None:
        """Merge levels that hold ``fanout`` runs, or all runs to one."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self._merge(self.levels[level], level + 1)
            level += 1
        every = sum(self.levels, [])
        if to_one and len(every) > 1:
            self._merge(every, len(self.levels) - 1)

    def _merge(self, paths: list[str], into: int) -> None:
        paths = list(paths)
        merged = self.read(paths).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))
        path = self._write(merged, f"run-{self.made}")
        self.made += 1
        for level in self.levels:
            level[:] = [p for p in level if p not in paths]
        if into == len(self.levels):
            self.levels.append([])
        self.levels[into].append(path)
        for p in paths:
            drop_dir(self.spark, p)

    def known(self) -> DataFrame:
        self.compact(to_one=True)
        return self.read(sum(self.levels, []))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``docs`` (all columns) with ``lines`` (array), ``kept`` (array of lines that stay)."""
    spark = docs.sparkSession
    keys = keyed_lines(docs.select("doc_id", "text"), min_chars)
    path = fresh_dir(spark, "line-keys")
    (keys.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)).cast("int"))
     .write.partitionBy("batch").parquet(path))
    keys = spark.read.schema("doc_id long, text_hash long, pos int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b))
    often = runs.known().where(F.col("n") >= min_docs).select("h1", "h2", "holder")
    drops = (keys.join(often, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
             .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash")).agg(F.collect_set("pos").alias("dropped")))
    cols = list(docs.columns)
    out = (docs.select(F.struct(*[f"`{c}`" for c in cols]).alias("row"), F.col("doc_id").alias("of"), F.xxhash64("text").alias("text_hash"))
           .join(drops, F.col("of").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")), "left")
           .select("row", lines_of(F.col("row.text")).alias("lines"), "dropped"))
    at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.transform(at, lambda i: F.get("lines", i)))
    return out.select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))


def op7_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
                      F.sha2(F.concat_ws("\n", "kept"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.holder AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
