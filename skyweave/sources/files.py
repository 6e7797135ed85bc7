"""Small files and listings of any file system that Spark reaches."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return bool(fs.exists(where))


def listing(spark: SparkSession, path: str) -> dict[str, bool]:
    """Names under a folder, and whether each is a folder; none where there is no such folder."""
    fs, where = _at(spark, path)
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return {}
    return {status.getPath().getName(): bool(status.isDirectory()) for status in fs.listStatus(where)}


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's own data files, without marks and files that are being written."""
    return sorted(name for name, folder in listing(spark, path).items() if not folder and name[0] not in "_.")


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file whole or not at all; False if one of that name is there already."""
    fs, where = _at(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = not fs.exists(where) and bool(fs.rename(draft, where))
    if not done:
        fs.delete(draft, False)
    return done


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a file of one writer anew."""
    fs, where = _at(spark, path)
    stream = fs.create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


class Busy(RuntimeError):
    """Another writer is at work."""


@contextmanager
def only_writer(spark: SparkSession, path: str, stale_after: float = 7600) -> Iterator[None]:
    """Hold the lock file at path, or raise Busy. A lock older than stale_after seconds is one whose holder died."""
    fs, where = _at(spark, path)
    for _ in range(2):
        try:
            fs.create(where, False).close()
            break
        except Py4JJavaError:
            if not fs.exists(where):  # let go meanwhile
                continue
            if time.time() - fs.getFileStatus(where).getModificationTime() / 1000 < stale_after:
                raise Busy(f"{path} is held") from None
            fs.delete(where, False)
    else:
        raise Busy(f"{path} is held")
    try:
        yield
    finally:
        fs.delete(where, False)
