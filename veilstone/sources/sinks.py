"""Sinks: every write goes to a fresh versioned folder, and an entry in a numbered log makes it current."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import versions


def publish(df: DataFrame, folder: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write ``df`` below ``folder`` and make it the next version in the folder's log. Readers see the old
    version until the log has the new one, which a plain overwrite can't promise; of two writers the one that
    takes the higher number is current, whatever their clocks say."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    versions.append(df.sparkSession, f"{folder}/versions", {"path": path, "format": fmt, "schema": df.schema.json()})
    return path


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest published version."""
    number = versions.last(spark, f"{folder}/versions")
    if not number:
        raise FileNotFoundError(f"nothing is published in {folder}")
    last = versions.entry(spark, f"{folder}/versions", number)
    return spark.read.format(last["format"]).schema(StructType.fromJson(json.loads(last["schema"]))).load(last["path"])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where the session leaves it unset
    a session on one machine takes a new temporary folder; on a cluster that is an error, since executors
    can't see the driver's folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veilstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a folder of its own, and read back: what is used several times is made once."""
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, buckets: int = 64) -> DataFrame:
    """``df`` with ``doc_bucket``, to partition a large log by."""
    return df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
