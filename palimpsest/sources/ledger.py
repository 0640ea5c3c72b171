"""The ledger of batch runs, and the files that a run leaves.

The ledger is a Parquet folder that only grows. A missing ledger holds nothing; one that cannot be read raises, so that
nothing is done again for a fault of the storage.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA = "batch_id string, name string, slug string, input_pdf string, pages struct<first:int,last:int>, status string, attempts int, error string, output_dir string, cleaned_sha256 string, lt_local string, metadata_source string, metadata_confidence double, recorded_at timestamp"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromDDL(SCHEMA)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    fields = StructType.fromDDL(SCHEMA).fields
    rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)).write.mode("append").parquet(path)


def report(df: DataFrame, raw_col: str, clean_prefix: str = "clean_", structured_prefix: str = "structured_") -> DataFrame:
    """``df`` with hashes of raw and cleaned text and both counters, as one JSON report column."""
    body = F.struct(F.sha2(F.col(raw_col), 256).alias("raw_sha256"), F.sha2(F.col(f"{structured_prefix}text"), 256).alias("cleaned_sha256"), F.col(f"{clean_prefix}stats").alias("cleanup_stats"), F.col(f"{clean_prefix}warnings").alias("cleanup_warnings"), F.col(f"{structured_prefix}stats").alias("structure_stats"))
    return df.withColumn("report", F.to_json(body))


def export_files(df: DataFrame, folder: str, name_col: str, text_col: str, kind: str = "md") -> int:
    """One file a row, '<name>.limpo.md' or '.txt', written by the workers to a shared folder; how many."""
    from ..operators.review import to_plain_text

    if kind not in ("md", "txt"):
        raise ValueError(f"unknown format: {kind}")
    body = to_plain_text(F.col(text_col)) if kind == "txt" else F.col(text_col)

    def run(parts):
        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for part in parts:
            for name, text in part.itertuples(index=False, name=None):
                if text is not None:
                    safe = re.sub(r"[/\\\0]", "_", name)
                    with open(os.path.join(folder, f"{safe}.limpo.{kind}"), "w", encoding="utf-8", newline="") as f:
                        f.write(text)
            yield pd.DataFrame({"n": [int(part.iloc[:, 1].notna().sum())]})

    return df.select(F.coalesce(F.col(name_col), F.lit("resultado")).alias("name"), body.alias("text")).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
