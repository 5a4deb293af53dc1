"""Runs a streaming query over what its source holds, into a table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.tables import table

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder in a local session that has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessera-streams-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def delete(spark: SparkSession, *folders: str) -> None:
    """Delete folders of the session's own, on whatever file system they are."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def events(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """The events as a stream of files, with ``ts`` as a time stamp that watermarks accept."""
    schema = table(spark, d, "events").schema
    # As a pattern, the name may be that of one file as well as of a folder.
    stream = spark.readStream.schema(schema).parquet(path or f"{d}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream emits until its source is used up.

    Appended rows are written by the exactly-once file sink. In complete and update
    mode each micro-batch is written in the place of its number, so that a repeated
    batch replaces itself; complete mode returns the last one, update mode all.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/tessera-streams/{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        delete(spark, f"{base}/state")
        return spark.read.schema(stream.schema).parquet(out)
    batches: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        batches.append(batch)

    writer.foreachBatch(write).start().awaitTermination()
    delete(spark, f"{base}/state")
    if not batches:
        return spark.createDataFrame([], stream.schema)
    wanted = batches[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{out}/batch={b}" for b in wanted])


def drain_arrivals(arrivals: Iterable[DataFrame], query: Callable[[DataFrame], DataFrame], conf: Mapping[str, str] | None = None, watch: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """All rows that a query in append mode emits over a stream whose rows arrive in the given portions.

    The stream goes on from its checkpoint after each portion, so that the watermark
    that a portion meets is that of all rows before it. The portions and the checkpoint
    are deleted at the end. conf: settings while it runs. watch: called after each portion.
    """
    out = None
    for rows in arrivals:
        spark = rows.sparkSession
        if out is None:
            base = f"{shared_folder(spark)}/tessera-streams/{uuid.uuid4().hex}"
        rows.write.mode("append").parquet(f"{base}/in")
        before = {k: spark.conf.get(k, None) for k in conf or ()}
        try:
            for k, v in (conf or {}).items():
                spark.conf.set(k, v)
            stream = query(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
            writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
            running = writer.format("parquet").option("path", f"{base}/out").start()
            running.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        if watch:
            watch(running)
        out = spark.read.schema(stream.schema).parquet(f"{base}/out")
    if out is None:
        raise ValueError("at least one portion is needed")
    delete(spark, f"{base}/in", f"{base}/state")
    return out
