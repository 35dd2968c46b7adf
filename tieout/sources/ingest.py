"""CSV sources: encoding, delimiter, header and types found out, cells coerced, rows numbered.

All columns are read as strings. A number or date column keeps its string beside
the typed value where some later cell doesn't fit the type that the sample gave,
so no cell is ever lost.
"""

from __future__ import annotations

import codecs
import csv
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.expr import number

# Fixed values of the reading rules: bytes and rows looked at, encodings, delimiters, and the patterns of types.
SNIFF_BYTES = 64 << 10
SAMPLE_ROWS = 2000
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
INTEGER = r"^[+-]?\d+$"
LEADING_ZERO = r"^[+-]?0\d+"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
GROUPED_NUMBER = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"
LONG_DIGITS = r"\d{16,}"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"
DATE = r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})$"
#: Ways in which Spark names the encodings.
_SPARK_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}


class IngestError(ValueError):
    """A file that can't be read as a table."""


@dataclass(frozen=True)
class ColumnSpec:
    ordinal: int
    header: str
    name: str
    kind: str  # INTEGER, REAL, TIMESTAMP, DATE or TEXT


def detect_encoding(head: bytes) -> str:
    """The first encoding that the bytes decode in; a character cut off at the end doesn't count against one."""
    for name in ENCODINGS:
        if name == "utf-8-sig" and not head.startswith(codecs.BOM_UTF8):
            continue
        try:
            codecs.getincrementaldecoder(name)().decode(head, final=False)
            return name
        except UnicodeDecodeError:
            continue
    return "latin-1"


def detect_delimiter(text: str) -> str:
    if not text.strip():
        raise IngestError("the file is empty")
    try:
        return csv.Sniffer().sniff(text, DELIMITERS).delimiter
    except csv.Error:
        return ","


def sanitised(headers: list[str], taken: tuple[str, ...] = ("row_id", "dup_of", "dup_kind")) -> list[str]:
    """Headers as lower-case identifiers, each one different and none reserved."""
    out: list[str] = []
    for i, h in enumerate(headers, 1):
        base = re.sub(r"\W+", "_", (h or "").strip()).strip("_").lower() or f"col_{i}"
        if base[0].isdigit():
            base = f"c_{base}"
        if base in taken:
            base = f"source_{base}"
        name, n = base, 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def infer_kinds(sample: DataFrame, columns: list[str]) -> dict[str, str]:
    """INTEGER, REAL, TIMESTAMP, DATE or TEXT for each string column, every non-blank value of the sample agreeing; one aggregate."""

    def fits(c: str):
        v = F.trim(c)
        whole = v.rlike(INTEGER) & ~v.rlike(LEADING_ZERO) & (F.length(F.regexp_replace(v, "[+-]", "")) <= 15)
        real = (v.rlike(PLAIN_NUMBER) | v.rlike(GROUPED_NUMBER)) & ~v.rlike(LEADING_ZERO) & ~(v.rlike(LONG_DIGITS) & ~v.rlike(r"[.eE]"))
        return {"INTEGER": whole, "REAL": real, "TIMESTAMP": v.rlike(TIMESTAMP), "DATE": v.rlike(DATE)}

    aggs = []
    for c in columns:
        some = F.trim(c) != ""
        aggs.append(F.count_if(some).alias(f"n|{c}"))
        aggs += [F.coalesce(F.bool_and(F.when(some, ok)), F.lit(False)).alias(f"{kind}|{c}") for kind, ok in fits(c).items()]
    row = sample.agg(*aggs).first().asDict()
    return {c: next((k for k in ("INTEGER", "REAL", "TIMESTAMP", "DATE") if row[f"n|{c}"] and row[f"{k}|{c}"]), "TEXT") for c in columns}


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with row_id 1, 2, ... in file order, without a window over all rows: places in a partition plus the sizes before it.

    The sizes are one row a partition. Both passes read the same splits of the
    same files, so places and sizes belong together.
    """
    tagged = df.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    # the hash makes the first pass parse whole rows, as the second does
    sizes = sorted(tagged.groupBy("__p").agg(F.count("*").alias("n"), F.max(F.xxhash64(*df.columns))).select("__p", "n").collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    known = F.broadcast(df.sparkSession.createDataFrame(starts, "__p int, __start long"))
    place = F.col("__m") - F.shiftleft(F.col("__p").cast("bigint"), 33) + F.col("__start") + 1
    return tagged.join(known, "__p").select(place.alias("row_id"), *df.columns)


def coerced(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """Typed columns from strings: blanks are null; a cell that doesn't fit its number type is null there and stays in ``<name>__raw``."""
    out = ["row_id"] if "row_id" in df.columns else []
    cells = []
    for s in specs:
        v = F.when(F.trim(s.name) != "", F.trim(s.name))
        if s.kind == "INTEGER":
            cells += [v.try_cast("bigint").alias(s.name), F.when(v.try_cast("bigint").isNull(), v).alias(f"{s.name}__raw")]
        elif s.kind == "REAL":
            cells += [number(v).alias(s.name), F.when(number(v).isNull(), v).alias(f"{s.name}__raw")]
        else:
            cells.append(v.alias(s.name))
    return df.select(*out, *cells)


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file wherever Spark can read it."""
    files = spark._jvm.org.apache.hadoop.fs
    where = files.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(stream.readNBytes(SNIFF_BYTES))
    finally:
        stream.close()


def fields_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field may go on in the next line: some line has an odd number of quotes.

    A field that is open at a line's end leaves its opening quote without a
    partner there; quotes inside fields are doubled. A stray quote counts as well,
    which only means that the file is read as one piece.
    """
    v = F.col("value")
    odd = (F.octet_length(v) - F.octet_length(F.replace(v, F.lit('"'), F.lit("")))) % 2 == 1
    return not spark.read.text(path).where(odd).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[ColumnSpec]]:
    """(rows with row_id, column specs) of a CSV file.

    Short rows are padded with nulls; cells beyond the header are dropped, as are
    blank lines. A file whose fields all end on their lines is read in as many
    tasks as it has splits; row ids are the same either way. Raises IngestError for an empty file or one without a header.
    """
    head = _head(spark, path)
    if not head.strip():
        raise IngestError(f"{path}: the file is empty")
    encoding = detect_encoding(head)
    text = head.decode(encoding, "replace")
    delimiter = detect_delimiter(text)
    headers = next(csv.reader([text.split("\n", 1)[0].rstrip("\r")], delimiter=delimiter), [])
    if not any(h.strip() for h in headers):
        raise IngestError(f"{path}: there is no header")
    names = sanitised([h.strip() for h in headers])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, sep=delimiter, encoding=_SPARK_NAMES[encoding], multiLine=fields_span_lines(spark, path), quote='"', escape='"', mode="PERMISSIVE")
    rows = numbered(raw)
    kinds = infer_kinds(rows.where(F.col("row_id") <= SAMPLE_ROWS), names)
    specs = [ColumnSpec(i, h, n, kinds[n]) for i, (h, n) in enumerate(zip(headers, names))]
    typed = coerced(rows, specs)
    # a raw column is kept only where it holds something
    raws = [c for c in typed.columns if c.endswith("__raw")]
    used = typed.agg(*[F.count(c).alias(c) for c in raws]).first() if raws else {}
    return typed.drop(*[c for c in raws if not used[c]]), specs


def ragged(spark: SparkSession, path: str, width: int, delimiter: str = ",") -> DataFrame:
    """(n_short, n_long): lines with fewer or more cells than the header; quoted delimiters are left out of the count."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.regexp_replace("value", '"[^"]*"', "").alias("v"))
    n = F.length("v") - F.length(F.replace("v", F.lit(delimiter), F.lit(""))) + 1
    return lines.agg(F.count_if(n < width).alias("n_short"), F.count_if(n > width).alias("n_long"))


def from_dataframe(df: DataFrame, key: str | None = None) -> DataFrame:
    """A source from any DataFrame: ``row_id`` from a column that is a unique number, or numbered in the order given."""
    if key:
        return df.withColumn("row_id", F.col(key).cast("bigint"))
    return df if "row_id" in df.columns else numbered(df)


def page(df: DataFrame, after: int = 0, limit: int = 50) -> DataFrame:
    """Up to 500 rows with larger row ids, by a range filter and not by skipping rows."""
    return df.where(F.col("row_id") > after).orderBy("row_id").limit(min(limit, 500))


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")
