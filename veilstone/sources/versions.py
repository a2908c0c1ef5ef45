"""A numbered log of small JSON entries in a folder, where two writers can't both take a number.

An entry is written aside and then moved to ``00000042.json`` only if that name is free, so it appears whole or
not at all. The file system decides who wins; no clock takes part.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Other writers changed the same rows first, as often as the writer was ready to try again."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def local_path(spark: SparkSession, name: str) -> str | None:
    """The plain path of a name on a local or mounted file system, None on another store."""
    path, fs = _path(spark, name)
    return fs.makeQualified(path).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def write_text(spark: SparkSession, name: str, text: str) -> None:
    path, fs = _path(spark, name)
    out = fs.create(path, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, name: str) -> str:
    path, fs = _path(spark, name)
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> dict[str, int]:
    """What lies in ``folder``, with the time of its last change in milliseconds; empty if there is none."""
    path, fs = _path(spark, folder)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(path)} if fs.exists(path) else {}


def remove(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def _taken(error: Py4JJavaError) -> bool:
    return "AlreadyExists" in error.java_exception.getClass().getName()


def put_if_absent(spark: SparkSession, name: str, text: str, link: bool = True) -> bool:
    """Write ``text`` to ``name`` if there is no such file; False if there is. Local file systems do that by a
    hard link (``link``), others by a rename that doesn't overwrite, which must be atomic there: it is
    on distributed file systems, not on plain object stores."""
    path, fs = _path(spark, name)
    aside = f"{path.getParent().toString()}/.{uuid.uuid4().hex}"
    write_text(spark, aside, text)
    try:
        if link and fs.getUri().getScheme() == "file":
            os.link(_path(spark, aside)[0].toUri().getPath(), path.toUri().getPath())
        else:
            jvm, gateway = spark._jvm, spark.sparkContext._gateway
            options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, aside)[0], path, options)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if _taken(error):
            return False
        raise
    finally:
        remove(spark, aside)


def numbers(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, folder) if n.endswith(".json") and n[:-5].isdigit())


def entry(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(read_text(spark, f"{folder}/{number:08d}.json"))


def last(spark: SparkSession, folder: str) -> int:
    """The highest number taken, 0 in an empty log."""
    return max(numbers(spark, folder), default=0)


def take(spark: SparkSession, folder: str, number: int, what: dict) -> bool:
    """Make ``what`` entry ``number``; False if another writer has."""
    return put_if_absent(spark, f"{folder}/{number:08d}.json", json.dumps(what, sort_keys=True))


def append(spark: SparkSession, folder: str, what: dict) -> int:
    """Make ``what`` the next entry, behind those of other writers, and return its number."""
    number = last(spark, folder) + 1
    while not take(spark, folder, number, what):
        number += 1
    return number
