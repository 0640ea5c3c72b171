"""Incremental cleaning: new extractions are cleaned as they arrive, each once.

A file stream feeds the same operators as a batch. The checkpoint keeps what was read and every id that was
written, so that a row comes out once however old it is and whenever it is delivered again; no row is dropped
for its age. The ids lie in RocksDB, on the executors' disks, not in their memory. Counters by arrival time are
a windowed aggregate behind a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.structure import clean_and_structure

STATE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def extraction_stream(spark: SparkSession, folder: str, like: DataFrame, *, files: int = 16) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def clean_stream(rows: DataFrame, out: str, checkpoint: str, *, enhanced: bool = False) -> StreamingQuery:
    """Write cleaned and structured texts of all that is there, then stop; call again for what came since.

    A checkpoint written when ids were kept for some days only cannot be continued.
    """
    once = rows.dropDuplicates(["extraction_id"])  # no watermark: it would drop the rows that lie behind it
    cleaned = clean_and_structure(once, "raw_text", enhanced=enhanced)
    writer = cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    conf, before = rows.sparkSession.conf, rows.sparkSession.conf.get(STATE, None)
    conf.set(STATE, ROCKSDB)  # a query takes the settings of its start
    try:
        return writer.start()
    finally:
        conf.unset(STATE) if before is None else conf.set(STATE, before)


def arrivals(rows: DataFrame, *, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Texts and characters by arrival window and engine; rows later than ``late`` no longer count."""
    timed = rows.withWatermark("received_at", late)
    return timed.groupBy(F.window("received_at", window).alias("w"), "engine").agg(F.count("*").alias("texts"), F.sum(F.length("raw_text")).alias("chars")).select(F.col("w.start").alias("from"), "engine", "texts", "chars")
