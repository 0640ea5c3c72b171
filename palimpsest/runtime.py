"""Things every operator needs of the session: tables, materialised steps, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, set here only where it is unset (local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of a session, once; they may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be over
        pass


#: A step's shuffle files go as soon as it is written; else they lie on disk until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    spark, name = df.sparkSession, "spark.sql.shuffle.partitions"
    before, cleaned = spark.conf.get(name), spark.conf.get(_CLEANUP, "false")
    if partitions and partitions > int(before):
        spark.conf.set(name, str(partitions))
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
        spark.conf.set(_CLEANUP, cleaned)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a step as Parquet into the shared folder and read it again.

    Cuts the lineage so that Python stages and loops run once; survives the loss of executors,
    since the files lie in the shared folder. The table is removed when the driver ends.
    """
    path = _place(df.sparkSession, label)
    out = _written(df, path)
    atexit.register(_delete, df.sparkSession, path)
    return out


class Scratch:
    """Tables in the shared folder that go as soon as the block ends; what it returns must be materialized before.

    ``partitions`` of a table raises the number of shuffle partitions while it is made, where its size is known.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
        path = _place(self.spark, label)
        self.paths.append(path)
        return _written(df, path, partitions)

    def drop(self, label: str) -> None:
        for path in [p for p in self.paths if f"/palimpsest-{label}-" in p]:
            self.paths.remove(path)
            _delete(self.spark, path)

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Broadcast ``df`` only if its counted ``rows`` stay within ``limit``; else leave the join to a shuffle."""
    return F.broadcast(df) if rows <= limit else df


def salt_count(rows: int, per_bucket: int = 100_000) -> int:
    """Buckets so that each holds about ``per_bucket`` rows; at least one."""
    return max(1, -(-rows // per_bucket))
