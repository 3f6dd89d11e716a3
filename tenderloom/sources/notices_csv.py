"""The notice CSV: all columns as strings, UTF-8 with or without a byte order mark.

A quoted cell may hold line breaks, so where a record begins depends on all quotes before it. Files are still read by many
tasks: each counts the quotes of its part, the parities of the parts before it tell whether it begins inside a cell, and
the lines are put together to records by that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom import fixed_values as fixed
from tenderloom.operators.ordered import row_numbers
from tenderloom.session import frozen

MOST_RECORD_CHARS = 16 << 20


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """path, part, number, record: the records of quoted CSV files in order, blank ones left out; one row per record.

    Quotes inside a cell are doubled, so a line begins a record if the number of quotes before it is even. A record of more
    than `MOST_RECORD_CHARS` characters, as an unclosed quote makes it, is left out: it cannot be read.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    lines = frozen(lines.withColumn("quotes", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))))
    # one row for every part of a file
    earlier = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("path", "part").agg(F.sum("quotes").alias("quotes")).withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
    # a part is what one task has read, so it fits into one
    part = Window.partitionBy("path", "part").orderBy("place")
    ahead = F.coalesce(F.sum("quotes").over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = lines.withColumn("ahead", ahead).join(F.broadcast(parts.select("path", "part", "before")), ["path", "part"])
    begins = ((F.col("ahead") + F.col("before")) % 2 == 0).cast("int")
    numbered = counted.withColumn("number", F.sum(begins).over(part.rowsBetween(Window.unboundedPreceding, 0))).drop("quotes", "ahead", "before")
    # the lines of a part before its first record belong to the last record of the parts before it
    last = numbered.groupBy("path", "part").agg(F.max("number").alias("n"))
    begun = F.last(F.when(F.col("n") > 0, F.struct(F.col("part").alias("part"), F.col("n").alias("number"))), ignorenulls=True).over(earlier)
    last = last.select("path", "part", begun.alias("open"))
    own = F.struct("part", "number")
    placed = numbered.join(F.broadcast(last), ["path", "part"]).select(
        "path", F.when(F.col("number") > 0, own).otherwise(F.col("open")).alias("record"), F.struct("part", "place", "line").alias("line"))
    sized = placed.groupBy("path", "record").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line.line")).alias("size"))
    several = sized.filter("n > 1").select("path", "record", "size")
    single = placed.join(several, ["path", "record"], "left_anti").select("path", "record", F.col("line.line").alias("text"))
    joined = placed.join(several.filter(F.col("size") <= MOST_RECORD_CHARS), ["path", "record"]).groupBy("path", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda l: l["line"]), "\n").alias("text"))
    text = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), "\r$", "")
    records = single.unionByName(joined).select("path", "record.part", "record.number", text.alias("record"))
    return records.filter(F.btrim("record") != "")


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """Notice rows under ASCII names with `row_num` in file order; rows that cannot be read are left out.

    Columns are found by their header, so a file may lack some. A missing file gives an empty frame.
    """
    empty = T.StructType([T.StructField("row_num", T.LongType())] + [T.StructField(n, T.StringType()) for n in fixed.NOTICE_CSV_COLUMNS.values()])
    if not exists(spark, path):
        return spark.createDataFrame([], empty)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    header = [c.lstrip("\ufeff") for c in reader.csv(path).columns]
    bad = "_bad_row"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, bad]])
    records = frozen(csv_records(spark, path))
    # the first record of every file is its header
    heads = records.groupBy("path").agg(F.min(F.struct("part", "number")).alias("head"))
    rows = records.join(F.broadcast(heads), "path").filter(F.struct("part", "number") != F.col("head"))
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    read = rows.select("path", "part", "number", F.from_csv("record", F.lit(schema.toDDL()), options).alias("cells"))
    good = read.filter(F.col(f"cells.{bad}").isNull()).select(
        "path", "part", "number",
        *[(F.coalesce(F.col(f"cells.`{k}`"), F.lit("")) if k in header else F.lit("")).alias(v) for k, v in fixed.NOTICE_CSV_COLUMNS.items()])
    return row_numbers(good, [], ["path", "part", "number"], "row_num").select("row_num", *fixed.NOTICE_CSV_COLUMNS.values())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on whatever file system it lies."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0
