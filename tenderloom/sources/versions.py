"""A stored index whose tables change together, version by version.

Every batch writes its rows as new files, one folder per table, and nothing that is already there is touched. A version is
a manifest: a small file that names the folders belonging to it, in order, and the last batch of every stream. It is
written under another name and renamed, which either happens or does not, and fails if that version is there already. So a
reader sees one version of all tables, a batch that dies leaves files nobody names, and a batch that comes again is known
by its number and changes nothing.

A batch also writes the ids of the documents it replaces. A row is live if no later batch of the version has its document,
so replacing costs as much as the batch and reading one join on ids; `compacted` folds all batches into one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, BATCH, ATTEMPT = "doc_id", "version_batch", "version_attempt"
TOUCHED = "touched_documents"
COMPACT_AFTER = 32


class VersionConflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Version:
    """What one manifest says: its number, the (batch number, attempt) folders it is made of, table schemas, last batch per stream."""

    number: int
    batches: list[list] = field(default_factory=list)
    schemas: dict[str, str] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)


class _Files:
    """The file system of a folder, through Spark's own access to it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.files = self.path(folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.hadoop.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return [s.getPath().getName() for s in self.files.listStatus(path)] if self.files.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Writes a file that is there as a whole or not at all, and never replaces one."""
        waiting = f"{name}.{uuid.uuid4().hex}.waiting"
        stream = self.files.create(self.path(waiting), False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        context = self.hadoop.FileContext.getFileContext(self.files.getUri(), self.conf)
        options = self.gateway.new_array(self.hadoop.Options.Rename, 0)
        try:
            context.rename(self.files.makeQualified(self.path(waiting)), self.files.makeQualified(self.path(name)), options)
        except Exception as error:
            self.files.delete(self.path(waiting), False)
            if self.files.exists(self.path(name)):
                raise VersionConflict(name) from error
            raise


class VersionedIndex:
    """Tables with a `doc_id` under one folder."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/manifests/{number:012d}.json"

    def version(self, spark: SparkSession, number: int | None = None) -> Version:
        """A version, the last one by default; number 0 with no tables before the first commit."""
        files = _Files(spark, self.folder)
        if number is None:
            number = max((int(n[:-5]) for n in files.names(f"{self.folder}/manifests") if n.endswith(".json")), default=0)
        return Version(**json.loads(files.read(self._manifest(number)))) if number else Version(0)

    def _stored(self, spark: SparkSession, version: Version, table: str) -> DataFrame:
        schema = T.StructType([*T.StructType.fromJson(json.loads(version.schemas[table])).fields, T.StructField(BATCH, T.LongType()), T.StructField(ATTEMPT, T.StringType())])
        root = f"{self.folder}/data/{table}"
        folders = [f"{root}/{BATCH}={batch}/{ATTEMPT}={attempt}" for batch, attempt in version.batches]
        return spark.read.schema(schema).option("basePath", root).parquet(*folders)

    def table(self, spark: SparkSession, table: str, version: Version | None = None) -> DataFrame:
        """The live rows of a table in one version."""
        version = version or self.version(spark)
        rows = self._stored(spark, version, table)
        if len(version.batches) > 1:
            last = self._stored(spark, version, TOUCHED).groupBy(KEY).agg(F.max(BATCH).alias(BATCH))
            rows = rows.join(last, [KEY, BATCH], "left_semi")
        return rows.drop(BATCH, ATTEMPT)

    def commit(self, tables: Mapping[str, DataFrame], touched: DataFrame, stream: str = "", batch_id: int | None = None) -> int:
        """Replaces the documents of `touched` (doc_id) by the rows of the tables, as a new version; its number.

        A document without rows is gone afterwards. A batch number that the stream has already committed changes nothing.
        Ids are not null.
        """
        spark = touched.sparkSession
        now = self.version(spark)
        if batch_id is not None and batch_id <= now.streams.get(stream, -1):
            return now.number
        if now.schemas and set(tables) != set(now.schemas) - {TOUCHED}:
            raise ValueError(f"a version has the tables {sorted(set(now.schemas) - {TOUCHED})}")
        written = {**tables, TOUCHED: touched.select(KEY).distinct()}
        batch, attempt = now.number + 1, uuid.uuid4().hex
        for name, rows in written.items():
            rows.write.parquet(f"{self.folder}/data/{name}/{BATCH}={batch}/{ATTEMPT}={attempt}")
        return self._publish(spark, now, [*now.batches, [batch, attempt]], written, {**now.streams, **({} if batch_id is None else {stream: batch_id})})

    def _publish(self, spark: SparkSession, now: Version, batches: list[list], tables: Mapping[str, DataFrame], streams: dict[str, int]) -> int:
        schemas = {name: rows.schema.json() for name, rows in tables.items()}
        for name, schema in now.schemas.items():
            fields = [[(f["name"], f["type"]) for f in json.loads(s)["fields"]] for s in (schema, schemas[name])]
            if fields[0] != fields[1]:
                raise ValueError(f"the columns of {name} have changed")
        version = Version(now.number + 1, batches, schemas, streams)
        _Files(spark, self.folder).publish(self._manifest(version.number), json.dumps(version.__dict__))
        return version.number

    def compacted(self, spark: SparkSession) -> int:
        """A new version with the same live rows in one batch."""
        now = self.version(spark)
        if len(now.batches) < 2:
            return now.number
        batch, attempt = now.number + 1, uuid.uuid4().hex
        tables = {name: self.table(spark, name, now) for name in now.schemas if name != TOUCHED}
        tables[TOUCHED] = self._stored(spark, now, TOUCHED).select(KEY).distinct()
        for name, rows in tables.items():
            rows.write.parquet(f"{self.folder}/data/{name}/{BATCH}={batch}/{ATTEMPT}={attempt}")
        return self._publish(spark, now, [[batch, attempt]], tables, now.streams)
