"""Shared plumbing: Arrow mapping, stored intermediates, id splits."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of one Arrow batch are worked on in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` take about ``limit`` bytes a slice."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        for i, n in enumerate(sizes):
            held += n or 0
            if held >= limit:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: T.StructType, text: str = "text") -> DataFrame:
    """Map slices of ``df`` to columns of ``schema``; ``make()`` runs once a task and returns the slice function."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in slices(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) if not isinstance(v, pa.Array) else v.cast(f.type) for f, v in zip(arrow, work(piece))], schema=arrow)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set (tests on one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        global _OWN
        if _OWN is None:
            _OWN = tempfile.mkdtemp(prefix="tieout-")
        root = f"file://{_OWN}"
    return root.rstrip("/")


_OWN: str | None = None
_STORED: list[tuple[SparkSession, str, DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and no lost executor loses it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tieout-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED.append((spark, path, out))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, which nothing reads any more."""
    for i, (spark, path, own) in enumerate(_STORED):
        if own is df:
            _delete(spark, path)
            del _STORED[i]
            return


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, each query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_stored() -> None:
    """Delete what ``stored`` wrote; results that were not consumed yet become unreadable."""
    while _STORED:
        spark, path, _ = _STORED.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            return


atexit.register(drop_stored)


def free_name(df: DataFrame, base: str) -> str:
    """``base`` or, where ``df`` has a column of that name, ``base`` and a number."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in itertools.chain([base], (f"{base}{i}" for i in itertools.count(2))) if c.lower() not in taken)


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def share(n: int, bound: int) -> float:
    return 1.0 if n <= bound else bound / n


def sampled(df: DataFrame, bound: int, key: str, salt: int = 17) -> DataFrame:
    """At most about ``bound`` rows, chosen by a hash of ``key``: the same rows at every layout."""
    part = share(df.count(), bound)
    if part >= 1:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 20)) < int(part * (1 << 20)))
