"""WARC archives: one gzip member a record, written and read in sequence.

An archive is a binary value (a row), so it lives in any storage that Spark can
reach; ``spark.read.format("binaryFile")`` gives the same shape for .warc.gz
files. The reader takes bytes in pieces, inflates them member by member, frames
records by Content-Length and checks their digests.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.frames import stored

#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 4 << 20
#: Compressed bytes given to the inflater at a time.
PIECE = 64 << 10
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A response holds the payload; a revisit holds its HTTP head alone, which keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return member(fields, http)
    return member(fields, http + payload)


def inflate(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The content of each gzip member in turn; raises ValueError where one is cut short."""
    unpack, held, fed = zlib.decompressobj(31), [], False
    for piece in pieces:
        while piece:
            held.append(unpack.decompress(piece))
            fed = True
            piece = unpack.unused_data
            if unpack.eof:
                yield b"".join(held)
                unpack, held, fed = zlib.decompressobj(31), [], False
    if fed:
        raise ValueError("the archive ends within a gzip member")


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(fields by lower-case name, block, whether its block and payload digests hold) of each record."""
    for content in inflate(pieces):
        head, blank, rest = content.partition(b"\r\n\r\n")
        version, _, lines = head.decode().partition("\r\n")
        if not blank or not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines.split("\r\n"))}
        size = int(fields["content-length"])
        block = rest[:size]
        if len(block) < size or rest[size:] != b"\r\n\r\n":
            raise ValueError("a record's content doesn't match its Content-Length")
        whole = fields.get("warc-block-digest", "").removeprefix("sha1:") in ("", digest(block))
        if fields.get("warc-type") == "response" and (told := fields.get("warc-payload-digest", "").removeprefix("sha1:")):
            whole &= told == digest(block.partition(b"\r\n\r\n")[2])
        yield fields, block, whole


#: Shares over which the pages with one payload are dealt.
SALTS = 16
#: Words of 64 bits that say which payloads may occur twice.
WORDS = 1 << 16


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload with record_type and refers_to.

    Of pages with equal payloads of at least ``least_bytes`` the one with the
    smallest page_id is the response. A null html is an empty payload; repeated
    rows of the smallest page_id are all responses; rows with a null page_id are
    revisits where another id has the payload and responses otherwise.

    Digests of repeated payloads set bits of a table of one size at any scale. A
    page whose bit isn't set is a response and stays where it is; only the others,
    repeated ones and those that meet a bit by chance, move to their digest's first.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("sha", F.sha1("payload"))
    first = own.where(F.length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").select("sha", "first_id"), "repeated")
    bit = F.pmod(F.xxhash64("sha"), F.lit(WORDS * 64))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))
    words = first.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(one).alias("bits"))  # WORDS rows at most
    seen = own.withColumn("word", F.floor(bit / 64)).join(F.broadcast(words), "word", "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(one) != 0, F.lit(False)))
    apart = seen.where("NOT maybe").select("page_id", "url", "payload", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    # the pages of a frequent payload are dealt over SALTS shares
    shares = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = seen.where("maybe").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(shares, ["sha", "salt"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    both = both.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))
    return apart.unionByName(both)


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(name, content): archives of a warcinfo record and then a record a page, a few MB each."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])
    arrow = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{task:06d}-{number:06d}.warc.gz"
            info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([info, *held])], pa.binary())], schema=arrow)

        for batch in batches:
            for row in zip(*(c for c in map(lambda c: map(lambda v: v.as_py(), c), batch.columns))):
                held.append(page_member(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return decided(pages, least_bytes).select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, schema)


_RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("digest_ok", T.BooleanType()),
    ]
)


def _number(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(archives: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """The page records of archives: ids, url, payload (null for revisits), its length and digest, type, reference, check.

    Archives are read piece by piece; warcinfo records are skipped; a broken archive raises ValueError.
    """
    names = _RECORDS.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([pa.field(n, t) for n, t in zip(names, (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()))])
        for batch in batches:
            for i in range(batch.num_rows):
                value = batch.column(0)[i].as_buffer()
                rows = []
                for fields, block, whole in records(value[at : at + PIECE].to_pybytes() for at in range(0, value.size if value else 0, PIECE)):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                    whole &= kind == "revisit" or size == len(payload)
                    rows.append((_number(fields["warc-record-id"]), fields.get("warc-target-uri"), payload if payloads and kind == "response" else None, size, fields["warc-payload-digest"].removeprefix("sha1:"), kind, _number(fields.get("warc-refers-to")), whole))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), arrow)], schema=arrow)

    return archives.select(content).where(F.col(content).isNotNull()).mapInArrow(run, _RECORDS)


def op8_warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok of every page, read back from archives.

    A null html is an empty payload. Equal payloads are told by their SHA-1; rows
    that share the smallest page_id and a payload are all responses. An empty
    table gives an empty result.
    """
    archives = stored(write_archives(pages), "warc")
    return read_archives(archives, payloads=False).drop("payload", "url")


OP8_SQL = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), first AS (SELECT h, min(page_id) AS first_id FROM own GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
      ((strpos('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 1 AS BIGINT), 1)) - 1) * 16
       + strpos('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 2 AS BIGINT), 1)) - 1)
      >> (3 - (i * 5) % 4)) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  TRUE AS digest_ok
FROM own JOIN first USING (h)
"""
