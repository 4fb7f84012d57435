"""Quads by subject and by object: stores whose cost of a lookup follows the batch.

``IndexedQuads`` keeps the quads twice, in buckets of a hash of ``s`` and (URI objects
that are no types) of ``o``, with the bucket as folder.  A lookup finds the buckets
of its URIs (at most as many numbers as there are buckets), reads these folders and
joins inside them; nothing else is listed or scanned.

Every source answers the same two questions: ``about`` (quads of these subjects)
and ``pointing`` (quads of these URI objects).  ``FrameSource`` asks a plain DataFrame,
``LayeredSource`` a source, what was added to it, and what is gone from it.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadsync.session import keep_rows
from quadsync.vocab import LEXICAL_KEY, RDF_TYPE

#: rows of a bucket, about; more only beyond MOST_BUCKETS of them
BUCKET_ROWS = 8_000
MOST_BUCKETS = 1 << 16


BUNDLE_SCHEMA = "g string, s string, terms array<struct<p: string, o: string, o_kind: string, o_dt: string, o_lang: string, o_key: string>>"


def having(quads, predicates) -> DataFrame:
    """The quads of ``predicates`` of a DataFrame or a source."""
    if not isinstance(quads, DataFrame) and hasattr(quads, "having"):
        return quads.having(predicates)
    frame = quads if isinstance(quads, DataFrame) else quads.frame()
    return frame.where(F.col("p").isin(list(predicates)))


def bundles(quads, predicates) -> DataFrame:
    """Quads of ``predicates`` as rows ``(g, s, terms)`` that hold one or several of a subject: what
    a shuffle by subject moves before they are spread."""
    if not isinstance(quads, DataFrame) and hasattr(quads, "bundles"):
        return quads.bundles(predicates)
    frame = quads if isinstance(quads, DataFrame) else quads.frame()
    term = F.struct("p", "o", "o_kind", "o_dt", "o_lang", "o_key")
    return frame.where(F.col("p").isin(list(predicates))).select("g", "s", F.array(term).alias("terms"))


def bucket_of(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


class FrameSource:
    """A DataFrame of quads (or triples) as a source; every question is a semi join."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.sparkSession, self.columns = df.sparkSession, df.columns

    def frame(self) -> DataFrame:
        return self.df

    def _ask(self, uris: DataFrame, key: str, predicates) -> DataFrame:
        df = self.df if key == "s" else self.df.where(F.col("o_kind") == "uri")
        if predicates is not None:
            df = df.where(F.col("p").isin(list(predicates)))
        return df.join(uris.select(F.col("uri").alias(key)).distinct(), key, "left_semi").select(*self.columns)

    def about(self, uris: DataFrame, predicates=None) -> DataFrame:
        """Quads whose subject is a ``uri`` of ``uris`` (and whose predicate is one of ``predicates``)."""
        return self._ask(uris, "s", predicates)

    def pointing(self, uris: DataFrame, predicates=None) -> DataFrame:
        """Quads whose URI object is a ``uri`` of ``uris``."""
        return self._ask(uris, "o", predicates)


class SnapshotSource(FrameSource):
    """Stored rows as a source. An answer is written once: callers join it several times, and each would
    read the snapshot again."""

    def _ask(self, uris: DataFrame, key: str, predicates) -> DataFrame:
        return keep_rows(super()._ask(uris, key, predicates))


class LayeredSource:
    """A source with quads added and, by their columns ``gone_by``, taken away."""

    def __init__(self, base, added: DataFrame | None = None, gone: DataFrame | None = None, gone_by: list[str] = LEXICAL_KEY):
        self.base, self.gone, self.gone_by = base, gone, list(gone_by)
        self.added = FrameSource(added.select(*base.columns)) if added is not None else None
        self.sparkSession, self.columns = base.sparkSession, base.columns
        self._adds: dict[str, bool] = {}

    def adds(self, predicates) -> bool:
        """Whether links of one of ``predicates`` were added; asked of the added quads once."""
        new = [p for p in predicates if p not in self._adds]
        if new:
            there = {r["p"] for r in self.added.df.where(F.col("p").isin(new) & (F.col("o_kind") == "uri")).select("p").distinct().collect()}  # some of `new`
            self._adds.update({p: p in there for p in new})
        return any(self._adds[p] for p in predicates)

    def _both(self, old: DataFrame, new: DataFrame | None) -> DataFrame:
        if self.gone is not None:
            old = old.join(self.gone.select(*self.gone_by).distinct(), self.gone_by, "left_anti").select(*self.columns)
        return old if new is None else old.unionByName(new)

    def frame(self) -> DataFrame:
        return self._both(self.base.frame(), self.added.frame() if self.added else None)

    def having(self, predicates) -> DataFrame:
        if self.gone is not None:
            return having(self.frame(), predicates)
        old = having(self.base, predicates)
        return old if self.added is None else old.unionByName(having(self.added.df, predicates).select(*self.columns))

    def bundles(self, predicates) -> DataFrame:
        if self.gone is not None:
            return bundles(self.frame(), predicates)
        old = bundles(self.base, predicates)
        return old if self.added is None else old.unionByName(bundles(self.added.df, predicates))

    def about(self, uris: DataFrame, predicates=None) -> DataFrame:
        return self._both(self.base.about(uris, predicates), self.added.about(uris, predicates) if self.added else None)

    def pointing(self, uris: DataFrame, predicates=None) -> DataFrame:
        return self._both(self.base.pointing(uris, predicates), self.added.pointing(uris, predicates) if self.added else None)


class FilteredSource:
    """Those quads of a source for which ``condition`` holds."""

    def __init__(self, base, condition: Column):
        self.base, self.condition = base, condition
        self.sparkSession, self.columns = base.sparkSession, base.columns

    def frame(self) -> DataFrame:
        return self.base.frame().where(self.condition)

    def having(self, predicates) -> DataFrame:
        return having(self.base, predicates).where(self.condition)

    def bundles(self, predicates) -> DataFrame:
        return bundles(self.having(predicates), predicates)

    def about(self, uris: DataFrame, predicates=None) -> DataFrame:
        return self.base.about(uris, predicates).where(self.condition)

    def pointing(self, uris: DataFrame, predicates=None) -> DataFrame:
        return self.base.pointing(uris, predicates).where(self.condition)


def as_source(x):
    return FrameSource(x) if isinstance(x, DataFrame) else x


class BucketFolder:
    """Rows in folders ``n=<buckets>/b=<bucket>`` of the hash of one column."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        done = [st.getPath() for st in fs.listStatus(root) if st.getPath().getName().startswith("n=")] if fs.exists(root) else []
        done = [p for p in done if fs.exists(p.suffix("/_SUCCESS"))]
        if not done:
            raise FileNotFoundError(f"no bucketed rows below {self.path}")
        self.n = int(done[0].getName()[2:])
        self.root = f"{self.path}/n={self.n}"
        # names only, at most n of them
        self.present = {int(st.getPath().getName()[2:]) for st in fs.listStatus(done[0]) if st.getPath().getName().startswith("b=")}

    @staticmethod
    def write(rows: DataFrame, path: str, key: str, n_rows: int, bucket_rows: int = BUCKET_ROWS) -> None:
        """A bucket that holds far more rows than others is split over tasks and files."""
        n = min(MOST_BUCKETS, max(1, -(-n_rows // bucket_rows)))
        columns = rows.columns
        (rows.withColumn("b", bucket_of(F.col(key), n)).hint("rebalance", "b").sortWithinPartitions("b", key)
         .select(*columns, "b").write.mode("overwrite").partitionBy("b").parquet(f"{path.rstrip('/')}/n={n}"))

    def all(self) -> DataFrame:
        if not self.present:
            return self.spark.createDataFrame([], self.schema)
        return self._whole

    @cached_property
    def _whole(self) -> DataFrame:
        """One relation, whose files are listed once."""
        return self.spark.read.schema(self.schema).parquet(self.root)

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets of a one-column table (of all, if they are at least half of them: a path for each
        would be listed and kept by the driver at every question)."""
        wanted = {r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]), self.n).alias("b")).distinct().collect()}
        some = sorted(wanted & self.present)
        if not some:
            return self.spark.createDataFrame([], self.schema)
        if 2 * len(some) >= len(self.present):
            return self.all()
        reader = self.spark.read.schema(self.schema).option("basePath", self.root)
        return reader.parquet(*[f"{self.root}/b={i}" for i in some])


class IndexedQuads:
    """Quads in buckets of ``s`` and of ``o``, below one folder."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str]):
        self.sparkSession, self.path, self.columns = spark, path.rstrip("/"), list(columns)
        schema = ", ".join(f"{c} string" for c in self.columns)
        self.by_s = BucketFolder(spark, f"{self.path}/by_s", "s", schema)
        self.by_o = BucketFolder(spark, f"{self.path}/by_o", "o", schema)

    @staticmethod
    def write(quads: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> None:
        n, links = quads.agg(F.count(F.lit(1)), F.count(F.when((F.col("o_kind") == "uri") & (F.col("p") != RDF_TYPE), 1))).first()
        BucketFolder.write(quads, f"{path}/by_s", "s", n, bucket_rows)
        BucketFolder.write(quads.where((F.col("o_kind") == "uri") & (F.col("p") != RDF_TYPE)), f"{path}/by_o", "o", links, bucket_rows)

    def frame(self) -> DataFrame:
        return self.by_s.all().select(*self.columns)

    def _ask(self, folder: BucketFolder, uris: DataFrame, predicates) -> DataFrame:
        uris = uris.select(F.col("uri").alias(folder.key)).distinct()
        rows = folder.of(uris)
        if predicates is not None:
            rows = rows.where(F.col("p").isin(list(predicates)))
        return rows.join(uris, folder.key, "left_semi").select(*self.columns)

    def about(self, uris: DataFrame, predicates=None) -> DataFrame:
        return self._ask(self.by_s, uris, predicates)

    def pointing(self, uris: DataFrame, predicates=None) -> DataFrame:
        if predicates is not None and RDF_TYPE in predicates:
            raise ValueError("types are not kept by object")
        return self._ask(self.by_o, uris, predicates)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
