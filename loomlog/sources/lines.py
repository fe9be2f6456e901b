"""Logs as an ordered relation of lines (log_id, line_no, line), from texts and back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def by_log() -> Window:
    return Window.partitionBy("log_id").orderBy("line_no")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Each file under the path as one log, named by its path; only line feeds end lines."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("text"))
    return split_lines(texts)


def from_texts(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> DataFrame:
    return split_lines(spark.createDataFrame(list(texts), "log_id string, text string"))


def split_lines(texts: DataFrame) -> DataFrame:
    """(log_id, text) to lines, numbered from 0; a text that ends with a line feed has an empty last line."""
    return texts.select("log_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def join_lines(lines: DataFrame) -> DataFrame:
    """Lines back to one text per log. This is the only place where a log becomes one value."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("log_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def write_logs(lines: DataFrame, path: str) -> None:
    """A text file for each task's share of logs, lines in order."""
    lines.repartition("log_id").sortWithinPartitions("log_id", "line_no").select("line").write.text(path)


def renumber(lines: DataFrame, *order: str) -> DataFrame:
    """Dense numbers from 0, by ``order`` (default: line_no) within each log."""
    w = Window.partitionBy("log_id").orderBy(*(order or ("line_no",)))
    return lines.withColumn("line_no", (F.row_number().over(w) - 1).cast("long"))


def resplit(lines: DataFrame) -> DataFrame:
    """Lines that came to hold line feeds, as lines of their own."""
    parts = lines.select("log_id", "line_no", F.posexplode(F.split("line", "\n", -1)).alias("sub", "part"))
    return renumber(parts, "line_no", "sub").select("log_id", "line_no", F.col("part").alias("line"))


def tail(lines: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("log_id").orderBy(F.desc("line_no"))
    return renumber(lines.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r"))


def head(lines: DataFrame, n: int) -> DataFrame:
    return renumber(lines.withColumn("r", F.row_number().over(by_log())).where(F.col("r") <= n).drop("r"))


def rewrite_logs(lines: DataFrame, rewrite: Callable[[Iterator[str]], Iterator[str]], batch_rows: int = 5_000) -> DataFrame:
    """Run a sequential rewriter over each log: an iterator of lines to an iterator of lines.

    Logs are dealt by id and sorted by Spark, outside Python; a log streams through its task, so a rewriter holds no more
    than what it keeps itself.
    """
    schema = StructType([lines.schema["log_id"], *StructType().add("line_no", "long").add("line", "string")])
    id_type = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        rows = _Rows(batches)
        ids, numbers, out = [], [], []
        while rows.ahead():
            name = rows.log
            for number, line in enumerate(rewrite(rows.of(name))):
                ids.append(name)
                numbers.append(number)
                out.append(line)
                if len(out) >= batch_rows:
                    yield _batch(rows.id_type, ids, numbers, out)
                    ids, numbers, out = [], [], []
            rows.skip(name)
        if out:
            yield _batch(rows.id_type, ids, numbers, out)

    dealt = lines.select("log_id", "line_no", "line").repartition("log_id").sortWithinPartitions("log_id", "line_no")
    return dealt.mapInArrow(run, schema)


class _Rows:
    """Rows in order, one log after the other."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.rows, self.at, self.id_type, self.log = iter(batches), [], 0, None, None

    def ahead(self) -> bool:
        while self.at >= len(self.rows):
            batch = next(self.batches, None)
            if batch is None:
                return False
            self.id_type = batch.schema.field(0).type
            self.rows, self.at = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), 0
        self.log = self.rows[self.at][0]
        return True

    def of(self, name: object) -> Iterator[str]:
        while self.ahead() and self.log == name:
            line = self.rows[self.at][1]
            self.at += 1
            yield line

    def skip(self, name: object) -> None:
        for _ in self.of(name):
            pass


def _batch(id_type: pa.DataType, ids: list, numbers: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], names=["log_id", "line_no", "line"])
