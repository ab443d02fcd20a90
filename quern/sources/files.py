"""Sources: match files, tables, logs, snapshots, report tables and pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.subquery import with_row
from quern.operators.choosing import best_struct
from quern.operators.features import MATCH_SCHEMA


def match_files(spark: SparkSession, root: str, schema: str = MATCH_SCHEMA) -> DataFrame:
    """Match documents in root/<folder>/matches/*.json or *.json.zst (or root/matches), one row for each file.

    Columns of the schema, source_folder, source_file, load_error (true for unreadable files). Of a document stored
    both ways the compressed file counts.
    """
    read = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true")
    read = read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,json.zst}")
    d = read.schema(f"{schema}, _bad string").json(root)
    path = F.col("_metadata.file_path")
    d = d.select("*", F.regexp_extract(path, r"([^/]+)/matches/[^/]+$", 1).alias("source_folder"), F.col("_metadata.file_name").alias("source_file"))
    d = d.withColumn("load_error", F.col("_bad").isNotNull() | (F.col("info").isNull() & F.col("metadata").isNull()))
    stem = F.regexp_replace("source_file", r"\.json(\.zst)?$", "")
    d = d.withColumn("_stem", stem).withColumn("_plain", (~F.col("source_file").endswith(".zst")).cast("int"))
    first = d.groupBy("source_folder", "_stem").agg(F.min("_plain").alias("_plain"))
    return d.join(first, ["source_folder", "_stem", "_plain"], "left_semi").drop("_bad", "_stem", "_plain")


def sources_with(found: DataFrame, required: list[str]) -> DataFrame:
    """source, complete, missing: which sources own all required files; found has source and file."""
    have = found.select("source", "file").distinct()
    need = have.select("source").distinct().withColumn("file", F.explode(F.array(*[F.lit(f) for f in required])))
    gone = need.join(have, ["source", "file"], "left_anti").groupBy("source").agg(F.array_sort(F.collect_set("file")).alias("missing"))
    d = have.select("source").distinct().join(gone, "source", "left")
    return d.select("source", F.col("missing").isNull().alias("complete"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def rows_for_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a table for a list of keys, whatever its length."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def csv_ids(spark: SparkSession, path: str, column: str, kind: str = "string", unique: bool = True) -> DataFrame:
    """One column of a CSV file with a header; raises if it lacks the column or repeats a value (unique)."""
    d = spark.read.option("header", "true").csv(path)
    if column not in d.columns:
        raise ValueError(f"{path} has no column {column}")
    d = d.select(F.col(column).cast(kind)).where(F.col(column).isNotNull())
    if unique and not d.groupBy(column).count().where("count > 1").isEmpty():
        raise ValueError(f"{path} repeats values of {column}")
    return d.distinct()


def json_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) rows of a JSON file {key: [values]}; a malformed file is empty."""
    text = spark.read.option("wholetext", "true").text(path)
    m = F.from_json("value", "map<string,array<string>>")
    return text.select(F.explode(m).alias(key, "_v")).select(key, F.explode("_v").alias(value))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def markdown_table(lines: DataFrame, header: list[str], line: str = "value", order: str = "line_no") -> DataFrame:
    """Rows of the pipe table under an exact header, up to the first line that does not start with a pipe.

    lines has the text and its number. Columns are text, named as the header; a table without rows raises on `require`.
    """
    want = "| " + " | ".join(header) + " |"
    at = lines.where(F.trim(F.col(line)) == want).agg(F.min(order).alias("_start"))
    body = with_row(lines, at).where(F.col(order) > F.col("_start"))
    stop = body.where(~F.col(line).startswith("|")).agg(F.min(order).alias("_stop"))
    cells = F.transform(F.split(F.trim(F.col(line)), r"\|"), lambda x: F.trim(x))
    rows = with_row(body, stop).where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop")))
    rows = rows.withColumn("_c", F.slice(cells, 2, len(header))).where(F.size(cells) == len(header) + 2).where(~F.col(line).rlike(r"^\|[\s:|-]+\|\s*$"))
    return rows.select(*[F.get("_c", F.lit(i)).alias(h) for i, h in enumerate(header)])


def union_snapshot(snapshots: list[DataFrame], keys: list[str], at: Column | None = None) -> DataFrame:
    """Union of caches: distinct rows, or the first snapshot's row of each key where `at` tells their order."""
    tagged = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(snapshots)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return best_struct(every, keys, [F.col("_src")] if at is None else [at], largest=False).drop("_src")


class PageSource(DataSource):
    """Pages of JSON rows behind a `start`/`count` interface, here from files <path>/<start>.json; option `total`.

    path is a folder or a URI of any file system that pyarrow reads (hdfs, s3, gs, file), seen by all executors.
    A page that cannot be opened or read gives one row with a null row and its error, never nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "start int, row string, error string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.total, self.count = options["path"], int(options["total"]), int(options.get("count", "100"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s) for s in range(0, self.total, self.count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        try:
            at = f"{self.path}/{partition.value}.json"
            system, path = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)
            with system.open_input_stream(path) as f:
                rows = json.loads(f.read())
            if not isinstance(rows, list):
                raise ValueError("a page must be an array")
        except (OSError, ValueError) as e:
            yield partition.value, None, str(e)[:400]
            return
        for r in rows:
            yield partition.value, json.dumps(r, sort_keys=True), None
