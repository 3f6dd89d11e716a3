"""Evaluation sets, the workspace store and the files results are written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import fixed_values as fixed
from tenderloom.session import setting

EVAL_SCHEMA = (
    "id string, question string, expected_answer string,"
    " ground_truth struct<sources: array<string>, chunk_orders: array<int>, chunk_uids: array<string>>,"
    " query_type string, metadata_filter struct<institution: string>, memo string"
)
PROJECT_SCHEMA = "id string, name string, created_at string"
ITEM_SCHEMA = "id string, saved_at string, project_id string, type string, title string, payload map<string, string>"


# ---------------------------------------------------------------- evaluation sets
def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set in YAML, which has to be a list. Such a set is written by hand, so the driver reads it."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    items = yaml.safe_load(text)
    if not isinstance(items, list):
        raise ValueError("an evaluation set is a list of items")
    return spark.createDataFrame([i for i in items if isinstance(i, dict)], EVAL_SCHEMA)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


# ---------------------------------------------------------------- workspace
def read_workspace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Projects and items of a stored workspace; an unreadable file counts as an empty one."""
    schema = f"projects array<struct<{PROJECT_SCHEMA.replace(' string', ': string')}>>, items array<struct<{_struct(ITEM_SCHEMA)}>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.select(F.inline("projects")), raw.select(F.inline("items"))


def _struct(schema: str) -> str:
    return schema.replace("payload map", "payload: map").replace(" string,", ": string,")


def with_new(stored: DataFrame, rows: DataFrame, stamp: Column, stamp_name: str) -> DataFrame:
    """Append rows with a fresh id and time stamp."""
    added = rows.withColumn("id", F.expr("uuid()")).withColumn(stamp_name, stamp)
    return stored.unionByName(added, allowMissingColumns=True)


def of_project(items: DataFrame, project_id: str) -> DataFrame:
    return items.filter(F.col("project_id") == project_id)


def write_workspace(projects: DataFrame, items: DataFrame, folder: str) -> None:
    projects.write.mode("overwrite").parquet(f"{folder}/projects")
    items.write.mode("overwrite").parquet(f"{folder}/items")


# ---------------------------------------------------------------- results
def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunks as JSON lines, in folders by a bucket of the document id."""
    chunks.withColumn("bucket", bucket_of("doc_id", buckets)).write.mode("overwrite").partitionBy("bucket").json(path)


def write_index(rows: DataFrame, path: str, key: str = "doc_id", buckets: int | None = None) -> None:
    """Write an index table partitioned by a bucket of its key; only buckets that occur in the rows are replaced.

    The number of buckets is a property of the table: name it when the table is first written, as many as an update
    touches documents, so that an update does not touch every bucket. It is kept with every row.
    """
    n = buckets or index_buckets(rows.sparkSession)
    bucketed = rows.withColumn("buckets", F.lit(n)).withColumn("bucket", bucket_of(key, n))
    bucketed.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)


def index_buckets(spark: SparkSession, stored: DataFrame | None = None) -> int:
    """The number of buckets a stored table has, or the setting for new ones."""
    known = stored.select("buckets").head() if stored is not None and "buckets" in stored.columns else None
    return known[0] if known else setting(spark, "index.buckets", 1024)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def written_rows_match(spark: SparkSession, path: str, expected: int) -> bool:
    return spark.read.parquet(path).count() == expected


def write_run_summary(runs: DataFrame, path: str) -> None:
    runs.select(*fixed.RUN_SUMMARY_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def checklist(spark: SparkSession) -> DataFrame:
    """The rows of the submission checklist."""
    return spark.createDataFrame(fixed.CHECKLIST_ROWS, "`항목` string, `체크` string, `비고` string")
