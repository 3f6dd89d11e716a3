"""Keeping stored tables up to date: re-indexing by document, metadata repair, workspace rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom import fixed_values as fixed
from tenderloom.functions import names
from tenderloom.functions.text import first_non_blank, match_key, strip
from tenderloom.operators.ordered import running_before


# ---------------------------------------------------------------- re-indexing
def upserted(stored: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """The stored rows without the documents that come anew, plus the new rows. Running it twice changes nothing."""
    again = fresh.select(key).distinct()
    return stored.join(again, [key], "left_anti").unionByName(fresh, allowMissingColumns=True)


def without_document(stored: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.join(removed.select(key).distinct(), [key], "left_anti")


def cascade_delete(items: DataFrame, deleted_projects: DataFrame, key: str = "project_id") -> DataFrame:
    """Items whose project is not deleted; items without a project stay."""
    return items.join(deleted_projects.select(key).distinct(), [key], "left_anti")


# ---------------------------------------------------------------- repair
def extension_index(files: DataFrame, file_name: Column, file_format: Column, order: Column) -> DataFrame:
    """Extension of every file stem: that of its name, else its stated format; the first row of a stem wins."""
    base = strip(F.coalesce(file_name, F.lit("")))
    ext = F.coalesce(
        F.nullif(names.family_extension(names.path_suffix(names.base_name(base))), F.lit("")),
        F.nullif(names.family_extension(file_format), F.lit("")),
    )
    stem = strip(names.path_stem(names.base_name(base)))
    return files.select(F.lower(stem).alias("stem"), ext.alias("ext"), order.alias("line_no")).filter(
        "ext is not null and stem <> ''"
    )


def inferred_sources(metadata: DataFrame, index: DataFrame) -> DataFrame:
    """Add source_norm and inferred_ext: the suffix of the source, else by stem, else by its letters and digits."""
    raw = first_non_blank(*[F.col(c) for c in ("source", "source_file", "filename") if c in metadata.columns])
    name = names.base_name(raw)
    rows = metadata.withColumn("source_norm", strip(names.path_stem(name)))
    rows = rows.withColumn("__suffix", F.nullif(names.family_extension(names.path_suffix(name)), F.lit("")))
    by_stem = index.groupBy(F.col("stem").alias("__stem")).agg(F.min_by("ext", "line_no").alias("__by_stem"))
    by_key = index.groupBy(match_key(F.col("stem")).alias("__key")).agg(F.min_by("ext", "line_no").alias("__by_key"))
    rows = rows.withColumn("__stem", F.lower("source_norm")).withColumn("__key", match_key(F.col("source_norm")))
    rows = rows.join(by_stem, ["__stem"], "left")
    rows = rows.join(by_key.filter("__key <> ''"), ["__key"], "left")
    return rows.withColumn("inferred_ext", F.coalesce("__suffix", "__by_stem", "__by_key", F.lit(""))).drop(
        "__suffix", "__stem", "__key", "__by_stem", "__by_key"
    )


def repaired(metadata: DataFrame, index: DataFrame, materialize_type: bool = False) -> DataFrame:
    """Metadata with repaired source, source_ext and (on request) type, and flags for what changed."""
    rows = inferred_sources(metadata, index)
    norm, ext = F.col("source_norm"), F.col("inferred_ext")
    source_changed = (norm != "") & (strip(F.coalesce("source", F.lit(""))) != norm)
    ext_filled = (ext != "") & (names.family_extension(F.col("source_ext")) == "")
    old_type = F.lower(strip(F.coalesce("type", F.lit(""))))
    type_changed = (ext != "") & (old_type != ext) if materialize_type else F.lit(False)
    return rows.select(
        *[c for c in metadata.columns if c not in ("source", "source_ext", "type")],
        F.when(source_changed, norm).otherwise(F.col("source")).alias("source"),
        F.when(ext_filled, ext).otherwise(F.col("source_ext")).alias("source_ext"),
        F.when(type_changed, ext).otherwise(F.col("type")).alias("type"),
        source_changed.alias("source_normalized"), ext_filled.alias("ext_filled"), type_changed.alias("type_materialized"),
    )


def repair_counts(rows: DataFrame) -> DataFrame:
    changed = F.col("source_normalized") | F.col("ext_filled") | F.col("type_materialized")
    return rows.agg(
        F.count("*").alias("scanned"),
        F.count_if(changed).alias("changed"),
        F.count_if("source_normalized").alias("source_normalized"),
        F.count_if("ext_filled").alias("ext_filled"),
        F.count_if("type_materialized").alias("type_materialized"),
    )


def stored_metadata(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """A struct of metadata as a string map for stores that know scalars only: nulls dropped, nested values as JSON."""
    entries = []
    for field in df.schema[metadata].dataType.fields:
        value = F.col(f"{metadata}.{field.name}")
        nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        text = F.to_json(value) if nested else value.cast("string")
        entries.append(F.struct(F.lit(field.name).alias("key"), text.alias("value")))
    source = F.col(f"{metadata}.source") if "source" in df.schema[metadata].dataType.names else F.lit(None).cast("string")
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull() & ~e["key"].isin("source", "source_ext"))
    ext = names.source_extension(source)
    given = F.col(f"{metadata}.source_ext") if "source_ext" in df.schema[metadata].dataType.names else F.lit("")
    final_ext = F.coalesce(F.nullif(given, F.lit("")), F.nullif(ext, F.lit("")))
    extra = F.filter(
        F.array(
            F.struct(F.lit("source").alias("key"), F.nullif(names.source_stem(source), F.lit("")).alias("value")),
            F.struct(F.lit("source_ext").alias("key"), final_ext.alias("value")),
        ),
        lambda e: e["value"].isNotNull(),
    )
    return df.withColumn(metadata, F.map_from_entries(F.concat(kept, extra)))


# ---------------------------------------------------------------- run history
def run_anomalies(runs: DataFrame, keys: list[str], order: list[str], seconds: str, ok: Column) -> DataFrame:
    """Flag runs that took much longer than the successful runs before them.

    With fewer than ten of those a fixed limit applies, afterwards three times their mean. Failed runs are never
    flagged and never counted.
    """
    value = F.when(ok, F.col(seconds))
    history = running_before(runs, keys, order, value, "n_before", "seconds_before")
    mean = F.col("seconds_before") / F.greatest(F.col("n_before"), F.lit(1))
    slow = F.when(
        F.col("n_before") < fixed.ANOMALY_MIN_SAMPLES, F.col(seconds) > fixed.ANOMALY_SECONDS
    ).otherwise(F.col(seconds) > mean * fixed.ANOMALY_FACTOR)
    return history.withColumn("is_anomaly", F.coalesce(ok & slow, F.lit(False)))
