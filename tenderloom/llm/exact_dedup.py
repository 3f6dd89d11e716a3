"""Exact dedup by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Texts are equal when they are identical after all ASCII blanks are deleted. Each level looks only at rows whose group of
the level above has at least two members, so the hash of a whole text is needed only for texts that share length and
prefix with another. All levels are narrow rows counted with map-side aggregation, and the joins back to the rows have a
stored table on one side, so that adaptive execution can split the partition of a very large group.

Null texts count as empty, and empty texts are equal to each other. Rows that repeat an id and a text are one document
and come back as one row (`copies` says how many there were); a repeated id with different texts is one document per
text. Of equal texts the one with the most code points in the original stays, then the smallest id; a null id loses
against any other. Extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import BLANK, parted, text_of
from tenderloom.session import frozen

PREFIX_CHARS = 64


def normal_text(text_column: str = "text") -> Column:
    return F.regexp_replace(text_of(text_column), BLANK, "")


def text_digest(text_column: str = "text") -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normal_text(text_column).cast("binary"), 256)


def _prefix_key(text_column: str) -> Column:
    """Length and prefix as one number. Chance collisions only let a group through to the next level."""
    text = normal_text(text_column)
    return F.xxhash64(F.octet_length(text), F.left(text, F.lit(PREFIX_CHARS)))


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    return frozen(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))


def shared_prefixes(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The (length, prefix) keys that more than one row has."""
    sizes = frozen(docs.select(F.octet_length(normal_text(text_column)).alias("length"), _prefix_key(text_column).alias("prefix")))
    alike = sizes.join(_repeated(sizes, "length"), "length", "left_semi")
    return _repeated(alike.select("prefix"), "prefix")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", all_rows: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, copies.

    By default only documents of groups with two or more rows come back and only their texts are hashed as a whole.
    With `all_rows` every document comes back with its digest; the groups are found by the same refinement.
    """
    prefixes = shared_prefixes(docs, text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.char_length(text_of(text_column)).alias("n_chars"),
        _prefix_key(text_column).alias("prefix"), normal_text(text_column).alias("normal"),
    )
    if not all_rows:
        rows = rows.join(prefixes, "prefix", "left_semi")
    rows = rows.select("doc_id", "n_chars", "prefix", F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"))
    rows = frozen(
        rows.groupBy("doc_id", "text_sha256", "prefix")
        .agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    )
    first = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id"))["doc_id"]
    groups = frozen(
        rows.join(prefixes, "prefix", "left_semi").groupBy("text_sha256")
        .agg(first.alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    found = rows.join(groups, "text_sha256", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))
    found = found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "copies",
    )
    return found if all_rows else found.where("group_size > 1 OR copies > 1")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Repeated rows of one document become one row.

    Only rows with the id of a document that goes, or of one with repeated rows, are joined; the others pass as they are.
    """
    found = frozen(exact_groups(docs, id_column, text_column))
    clear, touched = parted(docs, id_column, found.where("NOT kept OR copies > 1").select("doc_id"))
    key = ["_dedup_id", "_dedup_text"]
    keyed = touched.select(F.struct(*touched.columns).alias("row"), F.col(id_column).alias(key[0]), text_digest(text_column).alias(key[1]))
    dropped, repeated = (
        found.where(which).select(F.col("doc_id").alias("r_id"), F.col("text_sha256").alias("r_text")).distinct()
        for which in ("NOT kept", "kept AND copies > 1")
    )

    def same(right: DataFrame) -> Column:
        return keyed[key[0]].eqNullSafe(right["r_id"]) & (keyed[key[1]] == right["r_text"])

    kept = keyed.join(dropped, same(dropped), "left_anti")
    if not repeated.isEmpty():
        once = keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(key)
        kept = kept.join(repeated, same(repeated), "left_anti").unionByName(once)
    return clear.unionByName(kept.select("row.*"))
