"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quadsync") -> SparkSession:
    """A local session for tests and the bench (clusters bring their own)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in CONF.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; where it is unset, a local
    session gets a fresh folder of our own, and any other is refused (its
    executors would each write to their own disk)."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quadsync-ckpt-", dir=os.environ.get("QUADSYNC_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def keep_rows(df):
    """``df`` written to the checkpoint folder (survives executor loss; never local) and read back. Compressed
    columns and computed once: a reliable ``checkpoint()`` computes rows twice and keeps them uncompressed, without sizes."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: ends a lineage the same way
cut_lineage = keep_rows


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers (once per application), wherever
    the driver found it; Spark sends the archive to the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="quadsync-package-")) / "quadsync.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, Path(home.name) / f.relative_to(home))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
