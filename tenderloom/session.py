"""Session set-up and the settings the operators read from it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tenderloom", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def setting(spark: SparkSession, name: str, default: int) -> int:
    """An integer setting `spark.tenderloom.<name>`, with a default."""
    return int(spark.conf.get(f"spark.tenderloom.{name}", str(default)))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only for local runs that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tenderloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def frozen(df: DataFrame) -> DataFrame:
    """The rows written once as a table in the shared folder and read back.

    Later stages cannot see another version of them, a lost executor costs no recomputation, and the size of the
    files tells Spark how to join them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tenderloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether the frame has no more than `rows` rows, reading no more than it must."""
    return df.limit(rows + 1).count() <= rows
