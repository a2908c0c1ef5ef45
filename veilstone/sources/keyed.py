"""Tables kept in buckets of a key, of which a change rewrites only the buckets that it touches.

A folder holds ``data``, with the files of every write, and ``log``, a numbered manifest for each version: the
schema and, for each bucket, its files. A version never changes. A writer reads the buckets that its keys fall into, writes
them anew and takes the next number of the log. If another writer took it first and touched other buckets,
both changes hold and nothing is written again; if it touched the same ones, the change is made again on what
the other left. The manifest, of one line a bucket and file, is all that reaches the driver.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import fresh
from . import versions
from .versions import Conflict


def _bucket(key: Column, buckets: int) -> Column:
    """The bucket of a key, by its text, so that whole numbers have the same one whatever their type; null has 0."""
    return F.when(key.isNull(), 0).otherwise(F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets))).cast("int")


def _write(df: DataFrame, folder: str, key: str, buckets: int) -> dict[str, list[str]]:
    """Write ``df`` below ``folder`` and name the files of each bucket. Rows are dealt by bucket, and buckets
    that are much larger than others over several tasks."""
    column = fresh("bucket", df)
    part = f"data/{uuid.uuid4().hex}"
    dealt = df.withColumn(column, _bucket(F.col(key), buckets)).hint("rebalance", column)
    dealt.write.partitionBy(column).parquet(f"{folder}/{part}")
    found: dict[str, list[str]] = {}
    for name in versions.names(df.sparkSession, f"{folder}/{part}"):
        at = re.fullmatch(rf"{column}=(\d+)", name)
        if at:
            files = versions.names(df.sparkSession, f"{folder}/{part}/{name}")
            found[at[1]] = sorted(f"{part}/{name}/{f}" for f in files if not f.startswith(("_", ".")))
    return found


def create(df: DataFrame, folder: str, key: str = "doc_id", buckets: int = 64) -> int:
    """The first version of a table; Conflict if the folder has one."""
    manifest = {"key": key, "buckets": buckets, "schema": df.schema.json(), "files": _write(df, folder, key, buckets), "touched": None}
    if not versions.take(df.sparkSession, f"{folder}/log", 1, manifest):
        raise Conflict(f"{folder} holds a table")
    return 1


def _read(spark: SparkSession, folder: str, manifest: dict, only: list[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    held = manifest["files"]
    files = [f"{folder}/{f}" for b in (held if only is None else only) for f in held.get(b, ())]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, folder: str, version: int | None) -> tuple[int, dict]:
    number = version or versions.last(spark, f"{folder}/log")
    if not number:
        raise FileNotFoundError(f"no table in {folder}")
    return number, versions.entry(spark, f"{folder}/log", number)


def _touched(keys: DataFrame, manifest: dict) -> list[str]:
    """The buckets of ``keys``, read as the table's type: as many numbers as there are buckets, at most."""
    key = F.col(manifest["key"]).cast(StructType.fromJson(json.loads(manifest["schema"]))[manifest["key"]].dataType)
    found = keys.select(_bucket(key, manifest["buckets"]).alias("b")).distinct().collect()
    return sorted(str(r.b) for r in found)


def read(spark: SparkSession, folder: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """A version of the table, the newest by default; with ``keys`` only the buckets that they fall into are read,
    and only rows with one of them are returned (a null key finds none)."""
    manifest = _manifest(spark, folder, version)[1]
    if keys is None:
        return _read(spark, folder, manifest)
    key = manifest["key"]
    return _read(spark, folder, manifest, _touched(keys, manifest)).join(keys.select(key).distinct(), key, "left_semi")


def rewrite(spark: SparkSession, folder: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
    """Replace the buckets of ``keys`` by ``change`` of their rows, and return the new version's number.

    ``change`` is called again with the newer rows when another writer changed one of these buckets
    meanwhile; after ``tries`` calls that is a Conflict. Rows of other keys in these buckets come to ``change`` too,
    which must hand them back; a row for another bucket is a ValueError. No keys: nothing is written."""
    log = f"{folder}/log"
    number, manifest = _manifest(spark, folder, None)
    touched = _touched(keys, manifest)
    if not touched:
        return number
    for _ in range(tries):
        columns = StructType.fromJson(json.loads(manifest["schema"])).names
        made = _write(change(_read(spark, folder, manifest, touched)).select(*columns), folder, manifest["key"], manifest["buckets"])
        if not set(made) <= set(touched):
            raise ValueError("the change made rows for buckets that its keys don't fall into")
        while True:
            files = {b: f for b, f in manifest["files"].items() if b not in touched} | made
            if versions.take(spark, log, number + 1, manifest | {"files": files, "touched": touched}):
                return number + 1
            number += 1
            manifest = versions.entry(spark, log, number)
            if set(manifest["touched"] or touched) & set(touched):
                break
        number, manifest = _manifest(spark, folder, None)
    raise Conflict(f"{folder}: other writers changed the same buckets {tries} times")


def replace(spark: SparkSession, folder: str, keys: DataFrame, rows: DataFrame, tries: int = 5) -> int:
    """All rows of ``keys`` replaced by those of ``rows`` that have one of them, also by nothing."""
    key = _manifest(spark, folder, None)[1]["key"]
    named = keys.select(key).distinct()

    def change(old: DataFrame) -> DataFrame:
        return old.join(named, key, "left_anti").unionByName(rows.select(*old.columns).join(named, key, "left_semi"))

    return rewrite(spark, folder, keys, change, tries)


def history(spark: SparkSession, folder: str) -> list[tuple[int, int, int]]:
    """(version, buckets that it rewrote, files) of all versions kept; the first rewrote all."""
    out = []
    for n in versions.numbers(spark, f"{folder}/log"):
        m = versions.entry(spark, f"{folder}/log", n)
        out.append((n, len(m["files"] if m["touched"] is None else m["touched"]), sum(map(len, m["files"].values()))))
    return out


def vacuum(spark: SparkSession, folder: str, keep: int = 10, hours: float = 24.0) -> int:
    """Forget all versions but the last ``keep`` (1 at least), and remove the writes that none of these reads and
    that are older than ``hours``: younger ones may belong to a writer that has yet to take its number.
    Returns the number of writes removed."""
    log = f"{folder}/log"
    numbers = versions.numbers(spark, log)
    kept, gone = numbers[-max(1, keep) :], numbers[: -max(1, keep)]
    used = {f.split("/")[1] for n in kept for files in versions.entry(spark, log, n)["files"].values() for f in files}
    for n in gone:
        versions.remove(spark, f"{log}/{n:08d}.json")
    before = (time.time() - hours * 3600) * 1000
    old = [name for name, at in versions.names(spark, f"{folder}/data").items() if name not in used and at < before]
    for name in old:
        versions.remove(spark, f"{folder}/data/{name}")
    return len(old)
