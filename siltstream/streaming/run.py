"""Runs a stream over what is there now and returns its rows as a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir; it goes when the session's JVM ends. Without that setting there is a folder only if all tasks run on this machine."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/siltstream-{uuid.uuid4().hex[:12]}"
        context.setCheckpointDir(base)
    at = context._jvm.org.apache.hadoop.fs.Path(f"{str(base).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}")
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return str(files.makeQualified(at).toString())


def available_now(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Appends go to a file sink, exactly once; in mode complete each batch replaces the table with a whole one."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class Progress(StreamingQueryListener):
    """Tells a function (name, rows so far) how far each running query is; spark.streams.addListener(Progress(f))."""

    def __init__(self, tell: Callable[[str | None, int], None]):
        self.tell, self.rows = tell, {}

    def onQueryStarted(self, event):
        self.rows[str(event.runId)] = 0

    def onQueryProgress(self, event):
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + event.progress.numInputRows
        self.tell(event.progress.name, self.rows[run])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.rows.pop(str(event.runId), None)
