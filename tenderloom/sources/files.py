"""Document files: listing, parsing by an adapter, and choosing which still have to be done."""

from __future__ import annotations

import os
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.functions import names
from tenderloom.functions.text import nfkc
from tenderloom.sources.notices_csv import exists

PAGE_SCHEMA = "source string, file_type string, page int, text string, error string, seconds double"
Parser = Callable[[str, bytes], Iterable[tuple[int, str]]]


def list_files(spark: SparkSession, folder: str, pattern: str = "*.{pdf,hwp,hwpx}") -> DataFrame:
    """Path, name and size of the document files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", names.base_name(F.col("path")).alias("file_name"), "length", "modificationTime")


def not_yet_done(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files without a finished counterpart of the same stem, so that a run can be repeated."""
    stems = done.select(names.path_stem(F.col("file_name")).alias("stem")).distinct()
    return files.withColumn("stem", names.path_stem(F.col("file_name"))).join(stems, "stem", "left_anti").drop("stem")


def first_existing(spark: SparkSession, *globs: str) -> str | None:
    """The first path pattern that matches a file."""
    return next((g for g in globs if exists(spark, g)), None)


def parse_files(spark: SparkSession, folder: str, parser: Parser, pattern: str = "*.pdf") -> DataFrame:
    """One row per page of every file. A file that fails is one row with its error; the others go on.

    `parser(name, content)` yields (page, text) and runs in the tasks; a task holds one file at a time. `seconds` is the time
    the parser took for the whole file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source", "file_type", "page", "text", "error"]
        for batch in batches:
            for name, content in zip(batch["file_name"], batch["content"]):
                kind, started = name.rsplit(".", 1)[-1].lower(), time.perf_counter()
                try:
                    rows = [(name, kind, page, text, None) for page, text in parser(name, content)]
                except Exception as problem:
                    rows = [(name, kind, None, None, f"{type(problem).__name__}: {problem}")]
                yield pd.DataFrame(rows, columns=columns).assign(seconds=time.perf_counter() - started)

    named = files.select(nfkc(names.base_name(F.col("path"))).alias("file_name"), "content")
    return named.mapInPandas(parse, PAGE_SCHEMA)


def plain_text_parser(name: str, content: bytes) -> list[tuple[int, str]]:
    """Text files with form feeds between pages; stands in for a PDF parser, which is not part of this package."""
    return [(i, page.strip()) for i, page in enumerate(content.decode("utf-8").split("\f"), 1) if page.strip()]


def office_converter(binary: str = "libreoffice", seconds: int = 300) -> Callable[[str, bytes], bytes]:
    """A converter of HWP files to PDF by a headless office program, where one is installed."""

    def convert(name: str, content: bytes) -> bytes:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "input" + os.path.splitext(name)[1])
            with open(path, "wb") as file:
                file.write(content)
            command = [binary, "--headless", "--convert-to", "pdf", "--outdir", folder, path]
            subprocess.run(command, timeout=seconds, check=True, capture_output=True)
            with open(os.path.join(folder, "input.pdf"), "rb") as file:
                return file.read()

    return convert


def page_markdown(pages: DataFrame, doc_key: str = "source") -> DataFrame:
    """Pages back to one parsed Markdown text per document, with front matter and page markers."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    body = F.array_join(
        F.transform(ordered, lambda p: F.concat(F.lit("<<PAGE: "), p["page"].cast("string"), F.lit(">>\n\n"), p["text"], F.lit("\n"))), "\n"
    )
    made = pages.filter("text is not null").groupBy(doc_key).agg(body.alias("body"), F.count("*").alias("total_pages"), F.max("seconds").alias("duration_sec"))
    title = names.path_stem(F.col(doc_key))
    text = F.concat(
        F.lit("---\ndocument_title: "), title, F.lit("\nsource_file: "), F.col(doc_key), F.lit("\ntotal_pages: "),
        F.col("total_pages").cast("string"), F.lit("\n---\n\n"), "body",
    )
    return made.select(F.col(doc_key).alias("source"), "total_pages", "duration_sec", text.alias("text")).withColumn("doc_id", names.content_id(F.col("text")))
