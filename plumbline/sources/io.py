"""Readers and writers of the tables: XML records, JSON responses, CSV, YAML, vectors, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline import schemas
from plumbline.functions import text as X
from plumbline.operators.match import latest


def read_records(spark: SparkSession, path: str, row_tag: str = "inproceedings") -> DataFrame:
    """XML records of one tag (also gzipped); attributes have an underscore in front."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schemas.RECORD).load(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON responses; files that aren't JSON are skipped."""
    return spark.read.schema(schemas.WORKS).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a word list: one per line, lower-cased; # begins a comment."""
    word = F.lower(F.trim(F.regexp_replace("value", "#.*$", "")))
    return spark.read.text(path).select(word.alias("word")).filter("word <> ''").distinct()


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A YAML file through Spark's file system."""
    import yaml

    return yaml.safe_load("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def group_table(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """Groups (group, order, color) and their topics (label, group) of a grouping file; a label in two groups is an error."""
    groups = [(g["name"], i, g.get("color")) for i, g in enumerate(config["groups"])]
    topics = [(t, g["name"]) for g in config["groups"] for t in g["topics"]]
    seen: set[str] = set()
    twice = sorted({t for t, _ in topics if t in seen or seen.add(t)})
    if twice:
        raise ValueError(f"topics in more than one group: {', '.join(twice)}")
    return spark.createDataFrame(groups, "`group` string, `order` int, color string"), spark.createDataFrame(topics, "llm_label string, `group` string")


class NpyRows(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__(first)
        self.first, self.end = first, end


class NpyReader(DataSourceReader):
    """The header is read once; each partition reads the bytes of its own rows."""

    def __init__(self, options: dict):
        self.fs, self.path = pafs.FileSystem.from_uri(options["path"])
        with self.fs.open_input_file(self.path) as f:
            version = np.lib.format.read_magic(f)
            shape, fortran, self.kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            self.start = f.tell()
        if fortran and len(shape) > 1 or self.kind.kind not in "fiu" or len(shape) != 2:
            raise ValueError("a matrix of numbers, row by row, is wanted")
        self.rows, self.width = shape
        self.step = max(1, int(options.get("bytes", str(32 << 20))) // max(1, self.width * self.kind.itemsize))

    def partitions(self) -> list[NpyRows]:
        return [NpyRows(a, min(a + self.step, self.rows)) for a in range(0, self.rows, self.step)] or [NpyRows(0, 0)]

    def read(self, partition: NpyRows) -> Iterator[pa.RecordBatch]:
        size = self.width * self.kind.itemsize
        with self.fs.open_input_file(self.path) as f:
            for at in range(partition.first, partition.end, NPY_ROWS):
                n = min(NPY_ROWS, partition.end - at)
                f.seek(self.start + at * size)
                x = np.frombuffer(f.read(n * size), dtype=self.kind).astype(np.float32)
                if len(x) != n * self.width:
                    raise EOFError(f"{self.path} ends within row {at + len(x) // max(1, self.width)}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.width), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists], names=["id", "vec"])


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(dict(self.options))


#: Rows of a matrix that are read at a time.
NPY_ROWS = 10_000


def read_npy_ranges(spark: SparkSession, path: str, id_column: str = "id", part_bytes: int = 32 << 20) -> DataFrame:
    """Rows of a float matrix with their row numbers, as `read_npy`, in as many tasks as the file has parts of `part_bytes`.

    The path is a URI that pyarrow opens on every executor.  A file that ends
    too early is an error.
    """
    spark.dataSource.register(Npy)
    return spark.read.format("npy").option("bytes", part_bytes).load(path).withColumnRenamed("id", id_column)


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows of a file-based table with the column _place: file, block of the file, number within the block; it orders rows as they are in their files."""
    return rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("_place"))


def first_by_place(rows: DataFrame, key: str, last: bool = False) -> DataFrame:
    """Of each key the first row (or the last) in the order of files; rows without key go.  `rows` has to be read from files, unshuffled."""
    placed = in_file_order(rows)
    order = F.col("_place").desc() if last else F.col("_place").asc()
    return latest(placed, key, [order]).drop("_place")


def read_npy(spark: SparkSession, path: str, id_column: str = "id") -> DataFrame:
    """Rows of a float matrix with their row numbers, from an NPY file that any executor can reach through Spark; one task reads one file."""

    def rows(batches):
        import io

        import pandas as pd

        for batch in batches:
            for raw in batch["content"]:
                matrix = np.load(io.BytesIO(raw), allow_pickle=False).astype(np.float32)
                for at in range(0, len(matrix), 10_000):
                    yield pd.DataFrame({id_column: np.arange(at, min(at + 10_000, len(matrix)), dtype=np.int64), "vec": list(matrix[at : at + 10_000])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, f"{id_column} long, vec array<float>")


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined, so that the table can be CSV."""
    return df.select(*(X.joined(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file of a report (a small, already aggregated table)."""
    flat(df).coalesce(1).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def payload(df: DataFrame, order: list[str]) -> DataFrame:
    """One JSON text of a small table's rows, safe within a script element."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order))))
    return df.agg(X.escape_script(F.to_json(rows)).alias("payload"))


def _cell(v) -> str:
    """A value as a cell of a Markdown table: bars and backslashes are escaped, line ends become breaks."""
    text = "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\r\n", "<br>").replace("\n", "<br>").replace("\r", "<br>")


def markdown(df: DataFrame, order: list[str], limit: int = 200) -> str:
    """A Markdown table of a report's first rows; a last line says how many more there are."""
    rows = flat(df).orderBy(*order).limit(limit + 1).collect()
    lines = ["| " + " | ".join(map(_cell, df.columns)) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(_cell, r)) + " |" for r in rows[:limit]]
    if len(rows) > limit:
        lines.append(f"\n{df.count() - limit:,} more rows")
    return "\n".join(lines)


def propose_groups(df: DataFrame, label: str, group: str) -> str:
    """A grouping file, as YAML, of a mapping of labels to groups, for a reader to edit."""
    import yaml

    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(label)).alias("topics")).orderBy(group).collect()
    return yaml.safe_dump({"groups": [{"name": r[group], "topics": list(r["topics"])} for r in rows]}, allow_unicode=True, sort_keys=False)


def append_reviews(df: DataFrame, path: str) -> None:
    df.select(*schemas.REVIEWS.fieldNames()).write.mode("append").option("header", True).csv(path)


def update_reviews(log: DataFrame, changed: DataFrame, key: str = "dblp_key") -> DataFrame:
    """The log with changed verdicts in place of the old ones; of several changes of a key the one with the highest values, column by column, counts."""
    columns = [c for c in log.columns if c != key]
    new = latest(changed, key, [F.col(c).desc_nulls_last() for c in columns]).select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    return log.join(new, key, "left").select(key, *(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns))
