"""Sources of records: JSON folders, tables with an open tail, markdown folders, and sinks for them."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions import text as T


def json_folder(spark: SparkSession, path: str) -> DataFrame:
    """Records of all JSON arrays of a folder with their file's name; malformed files give no rows."""
    df = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(path)
    df = df.withColumn("_file_name", F.col("_metadata.file_name"))
    return df.withColumn("source", T.normalize_source(F.col("source"))) if "source" in df.columns else df


def open_table(table: DataFrame, tail: str) -> DataFrame:
    """A table with the JSON column ``extra`` merged back by a typed schema, internal columns dropped."""
    return table.withColumn("_x", F.from_json("extra", tail)).select(*(c for c in table.columns if c not in ("extra", "id", "created_at", "updated_at")), "_x.*")


def union_all(tables: dict[str, DataFrame]) -> DataFrame:
    """All collections under their names; missing columns are null."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("_file_name", F.lit(name)).drop("_id")
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def first_available(*loaders):
    """The result of the first loader that can load."""
    for load in loaders[:-1]:
        try:
            return load()
        except Exception:  # noqa: BLE001, S112  whatever its connector raises
            continue
    return loaders[-1]()


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with the fields of their front matter (name, value map), and the rest as content."""
    raw = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value"))
    front = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    fields = F.map_from_entries(F.transform(F.filter(F.split(front, "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]), F.btrim(F.split(x, ":", 2)[1], F.lit(" \"'")))))
    return raw.select("file_name", fields.alias("fields"), F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*\n", "").alias("content"))


def base64_document(body):
    """Bytes in the ``data`` field of a JSON body."""
    return F.unbase64(F.get_json_object(body, "$.data"))


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A whole new snapshot (Parquet); partitions replace each other dynamically."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic") if partition_by else w).parquet(path)


def obligations(results: DataFrame, documents: DataFrame, since: str | None = None, key: str = "doc_id") -> DataFrame:
    """Extracted results with their documents (those without one stay), by id; only results made since a date."""
    rows = results if since is None else results.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return rows.join(documents, key, "left").orderBy("id")


def extraction_text(column):
    """The JSON of an extraction that is an object or a string that holds one, as text."""
    inner = F.try_variant_get(F.try_parse_json(column), "$", "string")
    return F.when(inner.startswith("{"), inner).otherwise(column)


def demo_obligations(spark: SparkSession, path: str, extraction: str) -> DataFrame:
    """Records of a JSON file with ``extraction`` typed, whether the file has objects or strings there."""
    raw = spark.read.option("multiLine", True).json(path)
    held = raw.schema["extraction"].dataType.typeName()
    text = F.col("extraction") if held == "string" else F.to_json("extraction")
    return raw.withColumn("extraction", F.from_json(extraction_text(text), extraction))


def pdf_folder(spark: SparkSession, path: str, pages: Callable[[bytes], list[tuple[str, list[list[list[str]]]]]], ocr: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text, method) of PDF files.

    pages: a parser's text and tables of each page; tables follow their page's text as markdown.  Pages
    under 20 characters, and files under 50, are read again by ``ocr`` if there is one.  A file that cannot
    be read has an empty text and the method ``failed``.
    """

    def markdown(table: list[list[str]]) -> str:
        rows = [[(c or "").replace("\n", " ").strip() for c in r] for r in table]
        return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]) if rows else ""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in batch.itertuples(index=False):
                try:
                    found, method = [], "parsed"
                    for text, tables in pages(bytes(content)):
                        own = "\n\n".join(x for x in (text.strip(), *map(markdown, tables)) if x)
                        if len(own) < 20 and ocr:
                            own, method = ocr(bytes(content)), "mixed"
                        found.append(own)
                    whole = "\n\n".join(x for x in found if x)
                    if len(whole) < 50 and ocr:
                        whole, method = ocr(bytes(content)), "ocr"
                    rows.append((name, whole, method))
                except Exception:  # noqa: BLE001  whatever a parser raises on a broken file
                    rows.append((name, "", "failed"))
            yield pd.DataFrame(rows, columns=["path", "text", "method"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(read, "path string, text string, method string")


class Fetched(DataSource):
    """Python data source ``fetched``: (url, status, body, error) of the addresses in the option ``urls``
    (one a line), a partition each.

    ``get`` of a registered subclass does one request; a request that fails is tried four times in all,
    5, 10 and 15 seconds apart, and then leaves a row with its error.
    """

    TRIES, WAIT = 4, 5.0

    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return "url string, status int, body binary, error string"

    def get(self, url: str) -> tuple[int, bytes]:
        with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
            return answer.status, answer.read()

    def reader(self, schema) -> DataSourceReader:
        return _FetchReader(self, [u for u in self.options.get("urls", "").split("\n") if u])


class _FetchReader(DataSourceReader):
    def __init__(self, source: Fetched, urls: list[str]):
        self.source, self.urls = source, urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for attempt in range(1, self.source.TRIES + 1):
            try:
                yield (partition.value, *self.source.get(partition.value), None)
                return
            except Exception as e:  # noqa: BLE001  network errors of any kind
                error = str(e)
            if attempt < self.source.TRIES:
                time.sleep(attempt * self.source.WAIT)
        yield (partition.value, None, None, error[:500])
