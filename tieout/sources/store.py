"""Tables and small marks in folders that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_OWN: str | None = None
_WRITTEN: list[tuple[SparkSession, str]] = []
#: The innermost ``temporary`` of this thread.
_HERE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset, as in tests on one machine."""
    global _OWN
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN = _OWN or tempfile.mkdtemp(prefix="tieout-")
        root = f"file://{_OWN}"
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table: what is read several times is computed once, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tieout-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    if (own := getattr(_HERE, "own", None)) is not None:
        own.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables written inside are deleted on leaving; for steps whose result is no frame over them."""
    outer, _HERE.own = getattr(_HERE, "own", None), []
    try:
        yield
    finally:
        for spark, path in _HERE.own:
            _delete(spark, path)
            _WRITTEN.remove((spark, path))
        _HERE.own = outer


def discard(df: DataFrame) -> None:
    """Delete the table that ``df``, as ``written`` gave it, reads; other frames over it become unreadable."""
    files = {f.rsplit("/", 1)[0].split("://", 1)[-1].lstrip("/") for f in df.inputFiles()}
    for spark, path in list(_WRITTEN):
        if path.split("://", 1)[-1].lstrip("/") in files:
            _delete(spark, path)
            _WRITTEN.remove((spark, path))


def drop_written() -> None:
    """Delete the tables; frames over them become unreadable."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(drop_written)


class Folder:
    """A folder of any storage that Spark reaches: names, marks that only one writer can make, and deletion."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, sub: str) -> list[str]:
        """Names in a folder, in order; none where it isn't there."""
        where = self._jpath(f"{self.path}/{sub}")
        found = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted(n for n in found if not n.startswith("."))

    def mark(self, sub: str, text: str = "") -> bool:
        """Make a small file; False if it is there already. Of several writers one makes it, where the storage creates files atomically; on a local disk it appears with its text at once."""
        if self._fs.getScheme() == "file":
            return self._linked(self._fs.makeQualified(self._jpath(f"{self.path}/{sub}")).toUri().getPath(), text)
        try:
            out = self._fs.create(self._jpath(f"{self.path}/{sub}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    @staticmethod
    def _linked(path: str, text: str) -> bool:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, made = tempfile.mkstemp(prefix=".", dir=os.path.dirname(path))
        try:
            with os.fdopen(handle, "w", encoding="utf-8") as out:
                out.write(text)
            os.link(made, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(made)

    def text(self, sub: str) -> str:
        """What a small file says; nothing while it is being written."""
        try:
            source = self._fs.open(self._jpath(f"{self.path}/{sub}"))
        except Py4JJavaError:
            return ""
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        except Py4JJavaError:
            return ""
        finally:
            source.close()

    def delete(self, sub: str) -> None:
        self._fs.delete(self._jpath(f"{self.path}/{sub}"), True)
