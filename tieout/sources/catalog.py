"""Named sources with their column kinds and duplicate policy."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.expr import slug
from tieout.operators.dedup import duplicate_summary, mark_duplicates, without_duplicates
from tieout.sources.ingest import IngestError, from_dataframe, page, read_csv
from tieout.sources.store import Folder, discard, written

_NUMBERS = ("bigint", "int", "smallint", "double", "float")


@dataclass
class Dataset:
    name: str
    rows: DataFrame
    kinds: dict[str, str]
    role: str | None = None
    exclude_duplicates: bool = False

    def visible(self) -> DataFrame:
        """Rows that count under the duplicate policy."""
        return without_duplicates(self.rows, self.exclude_duplicates)

    @property
    def text_columns(self) -> list[str]:
        return [c for c, k in self.kinds.items() if k == "TEXT"]

    @property
    def number_columns(self) -> list[str]:
        return [c for c, k in self.kinds.items() if k in ("INTEGER", "REAL")]

    @property
    def date_columns(self) -> list[str]:
        return [c for c, k in self.kinds.items() if k in ("DATE", "TIMESTAMP")]


def kinds_of(df: DataFrame) -> dict[str, str]:
    """Kinds of a typed DataFrame's columns."""
    kind = lambda t: "INTEGER" if t in _NUMBERS[:3] else "REAL" if t in _NUMBERS or t.startswith("decimal") else "TIMESTAMP" if t.startswith("timestamp") else "DATE" if t == "date" else "TEXT"
    return {c: kind(t) for c, t in df.dtypes if c not in ("row_id", "dup_of", "dup_kind") and not c.endswith("__raw")}


@dataclass
class Catalog:
    spark: SparkSession
    datasets: dict[str, Dataset] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, kinds: dict[str, str] | None = None, role: str | None = None, key: str | None = None) -> Dataset:
        """Register a DataFrame; it is stored once, with its duplicates marked."""
        rows = from_dataframe(df, key)
        kinds = kinds or kinds_of(rows)
        own = Dataset(name, written(mark_duplicates(rows, list(kinds)), name), kinds, role)
        own.rows.createOrReplaceTempView(name)
        self.datasets[name] = own
        return own

    def add_csv(self, name: str, path: str, role: str | None = None) -> Dataset:
        rows, specs = read_csv(self.spark, path)
        return self.add(name, rows, {s.name: s.kind for s in specs}, role)

    def add_files(self, files: dict[str, str]) -> dict[str, str]:
        """Register CSV files by name; {name: error} of those that fail, which keep no other from being read."""
        failed = {}
        for name, path in files.items():
            try:
                self.add_csv(name, path)
            except (IngestError, OSError, PySparkException, Py4JError) as e:
                failed[name] = str(e)
        return failed

    def add_folder(self, path: str) -> dict[str, str]:
        """Register every CSV file of a folder under its file's name; {name: error} as of ``add_files``."""
        names = [n for n in Folder(self.spark, path).names("") if n.lower().endswith(".csv")]
        return self.add_files({slug(n[:-4]): f"{path.rstrip('/')}/{n}" for n in names})

    def scan(self) -> list[str]:
        """Look for duplicates in the sources where nobody did; their names."""
        done = self.unmarked()
        for n in done:
            d = self.datasets[n]
            d.rows = written(mark_duplicates(d.rows, list(d.kinds)), n)
            d.rows.createOrReplaceTempView(n)
        return done

    def set_policy(self, name: str, exclude_duplicates: bool) -> None:
        self.datasets[name].exclude_duplicates = exclude_duplicates

    def list(self) -> list[dict]:
        return [{"name": d.name, "role": d.role, "columns": len(d.kinds), "exclude_duplicates": d.exclude_duplicates} for d in self.datasets.values()]

    def describe(self, name: str) -> dict:
        d = self.datasets[name]
        marks = {r.dup_kind: r.n for r in duplicate_summary(d.rows).collect()}
        return {"name": name, "kinds": d.kinds, "n_rows": d.rows.count(), "duplicates": marks}

    def rows(self, name: str, after: int = 0, limit: int = 50) -> DataFrame:
        return page(self.datasets[name].rows, after, limit)

    def drop(self, name: str) -> None:
        """Forget a source; its files go, so frames over its rows become unreadable."""
        d = self.datasets.pop(name)
        self.spark.catalog.dropTempView(name)
        discard(d.rows)

    def reset(self) -> None:
        for name in list(self.datasets):
            self.drop(name)

    def unmarked(self) -> list[str]:
        """Sources whose duplicates were never looked for."""
        return [n for n, d in self.datasets.items() if "dup_of" not in d.rows.columns]

    def total_rows(self) -> DataFrame:
        parts = [d.rows.agg(F.count("*").alias("n_rows")).withColumn("dataset", F.lit(n)) for n, d in self.datasets.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
