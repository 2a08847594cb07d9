"""Session settings for tests and benchmarks, and the shared scratch folder.

Library code takes a session and never builds one; a cluster brings its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_fallback: list[str] = []


def local_session(cores: str | int = "*", app: str = "shelfline",
                  partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.runSQLOnFiles", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting (a test) falls back to a temporary folder.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_KEY
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        if not _local_fallback:
            _local_fallback.append(tempfile.mkdtemp(prefix="shelfline-"))
        root = _local_fallback[0]
    return f"{root.rstrip('/')}/shelfline/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """``df`` by way of a Parquet table in the shared folder.

    Cuts the lineage at a point that later steps read several times: what they
    see no longer changes, and a lost executor costs a read.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
