"""Reports and traces as tables: JSON lines, JSON arrays, trace CSV, and collecting that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import remaining
from ..operators.timeline import delta_encode

TRACE_SCHEMA = ", ".join(["unit long", "offset long", "bytes long", "input_timing int", "major_sync int", *(f"{c}{k} int" for c in ("dir", "ss") for k in range(4)), "extra int", *(f"out{k} int" for k in range(4))])


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A row a line; what can't be read is kept in _corrupt_record if the schema has it."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A buffer trace; its schema is fixed, so nothing is read twice to guess it."""
    return spark.read.schema(TRACE_SCHEMA).csv(path, header=True)


def write_trace(trace: DataFrame, path: str) -> None:
    trace.write.csv(path, header=True)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Events of a line-oriented text: a line "- ID: x" begins one, "key: value" lines follow. (path, event, id, key, value), in order; later events name only what changes, so fill them forward."""
    from pyspark.sql import Window

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    pair = r"^\s*(?:-\s+)?([\w. ]+?)\s*:\s*(.*?)\s*$"
    rows = files.withColumn("event", F.sum(F.col("text").rlike(r"^\s*-\s+ID\s*:").cast("int")).over(w))
    rows = rows.where(F.col("text").rlike(pair)).select("path", "line", "event", F.regexp_extract("text", pair, 1).alias("key"), F.regexp_extract("text", pair, 2).alias("value"))
    return rows.withColumn("id", F.last(F.when(F.col("key") == "ID", F.col("value")), ignorenulls=True).over(w)).select("path", "event", "id", "key", "value")


def collect_resumed(todo: DataFrame, path: str, keys: list[str], work) -> int:
    """Appends work(rows not yet in the table at path) to it; returns how many there were. A run that was cut off goes on where it ended."""
    spark = todo.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    rest = remaining(todo, spark.read.json(path), keys) if there else todo
    n = rest.count()
    if n:
        work(rest).write.mode("append").json(path)
    return n


def to_json_report(df: DataFrame, column: str = "report") -> DataFrame:
    """Each row as one JSON text, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def key_value_lines(events: DataFrame, element: str, order: list[str], fields: list[str]) -> DataFrame:
    """Events as the text that read_key_values reads: a row an event (order, lines), with the fields that changed since the element's event before."""
    sparse = delta_encode(events.select(element, *order, *fields), [element], order, fields)
    lines = [F.concat(F.lit("- ID: "), F.col(element).cast("string"))]
    lines += [F.concat(F.lit(f"  {f}: "), F.col(f).cast("string")) for f in fields]
    return sparse.select(*order, F.array_join(F.array_compact(F.array(*lines)), "\n").alias("lines"))


def write_key_values(events: DataFrame, element: str, order: list[str], fields: list[str], path: str) -> None:
    """key_value_lines as text files, sorted over all of them by range."""
    key_value_lines(events, element, order, fields).orderBy(*order).select("lines").write.text(path)
