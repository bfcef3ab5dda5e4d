"""WARC archives: written by Spark's text writer, read by a Python data source named ``warc``.

Writing is plain DataFrame work: records are put together as columns and saved through Spark's
commit protocol to any file system Spark knows. A payload of at least ``least`` bytes that other
records share is stored once, under the smallest id; the others become ``revisit`` records that
name it.

Reading plans its partitions over files, bundling small ones up to a byte size. Headers are
parsed first: a record whose type or other headers fail a pushed-down predicate has its block
skipped unread, and with ``payload`` off no payload is decoded at all. One record is in memory
at a time. Files are opened through ``pyarrow.fs``, plain or gzip-compressed.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.scalar import col

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
END = "\r\n"
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "refers_to string, headers map<string,string>, http map<string,string>, payload_bytes long, payload binary"
)
#: Columns that a header answers, and which header it is.
HEADER_OF = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def record_id(key: Column) -> Column:
    """A record's name, made from its key so that a repeated task writes the same one."""
    return F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))


def one_line(value: Column) -> Column:
    """Header values hold no line ends; null is left empty."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def with_revisits(df: DataFrame, ident: str, payload: str, least: int = 100) -> DataFrame:
    """``df`` with ``digest``, ``bytes`` and ``original``: the smallest id with an equal payload.

    ``original`` is null for a record that stores its payload. A null payload is empty. A null id
    is no one's original.
    """
    body = F.coalesce(col(payload).cast("string"), F.lit(""))
    sized = df.withColumns(
        {"digest": F.sha2(body, 256), "bytes": F.octet_length(body).cast("long")}
    )
    groups = (
        sized.where(F.col("bytes") >= least)
        .groupBy(F.col("digest").alias("g"))
        .agg(F.min(col(ident)).alias("original"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = sized.join(groups, F.col("digest") == F.col("g"), "left")
    original = F.when(~F.col("original").eqNullSafe(col(ident)), F.col("original"))
    return joined.drop("g").withColumn("original", original)


def write_warc(
    df: DataFrame, path: str, ident: str, uri: str, payload: str, least: int = 100, date: str = EPOCH
) -> None:
    """One record per row of ``df`` (ids distinct where not null), gzip-compressed, into folder ``path``.

    A null payload is empty, a null address too. A row without id is named by its payload's digest,
    under no page; it is a revisit where a row with id stores the same payload. Each record carries its payload's SHA-256, and
    its HTTP head the payload's length, also where a revisit leaves the payload out.
    """
    kept = df.select(col(ident).alias("id"), col(uri).alias("uri"), col(payload).cast("string").alias("body"))
    rows = with_revisits(kept, "id", "body", least)
    revisit = F.col("original").isNotNull()
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END + END),
    )
    block = F.concat(head, F.when(revisit, "").otherwise(F.coalesce("body", F.lit(""))))
    lines = F.concat(
        F.lit(f"{VERSION}{END}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{END}WARC-Record-ID: "),
        F.coalesce(record_id(F.col("id")), F.concat(F.lit("<urn:payload:"), F.col("digest"), F.lit(">"))),
        F.lit(f"{END}WARC-Date: {date}{END}WARC-Target-URI: "),
        one_line(F.col("uri")),
        F.lit(f"{END}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(F.lit(f"{END}WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), record_id(F.col("original"))),
        ).otherwise(""),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END + END),
    )
    # The writer ends every record with the two line ends that the format asks for.
    rows.select(F.concat(lines, block).alias("value")).write.option("lineSep", END + END).option(
        "compression", "gzip"
    ).text(path)


def page_of(record: Column) -> Column:
    """The key inside a record id that ``record_id`` made; null in any other."""
    return F.when(record.startswith("<urn:page:"), F.regexp_extract(record, r"^<urn:page:(.*)>$", 1))


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]) -> None:
        super().__init__(None)
        self.paths = paths


def records(stream: io.BufferedIOBase, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose headers ``wanted`` accepts; others are skipped."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        headers, last = {}, None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.rstrip(b"\r\n").decode("utf-8", "replace")
            if last and text[:1] in " \t":
                headers[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        left = int(headers["content-length"])
        if wanted(headers):
            block = stream.read(left)
            if len(block) < left:
                raise ValueError("a WARC record ends early")
            yield headers, block
        else:
            while left:
                skipped = len(stream.read(min(left, 1 << 20)))
                if not skipped:
                    raise ValueError("a WARC record ends early")
                left -= skipped


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Head and payload of an HTTP message."""
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("latin-1").partition(":")
        http[name.strip().lower()] = value.strip()
    return http, payload


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.bundle = int(options.get("bundlebytes", str(64 << 20)))
        self.payload = options.get("payload", "true").lower() == "true"
        self.accepted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and membership on header columns; the rest is left to Spark."""
        for item in filters:
            name = item.attribute[0] if isinstance(item, (EqualTo, In)) and len(item.attribute) == 1 else None
            if name not in HEADER_OF:
                yield item
                continue
            values = {item.value} if isinstance(item, EqualTo) else set(item.value)
            header = HEADER_OF[name]
            self.accepted[header] = self.accepted.get(header, values) & values

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        found = [
            f
            for f in system.get_file_info(fs.FileSelector(root, recursive=True))
            if f.is_file and not f.base_name.startswith(("_", "."))
        ]
        bundles, names, held = [], [], 0
        for file in sorted(found, key=lambda f: f.path):
            if names and held + file.size > self.bundle:
                bundles.append(Files(tuple(names)))
                names, held = [], 0
            names.append(file.path)
            held += file.size
        if names or not bundles:
            bundles.append(Files(tuple(names)))
        return bundles

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path)
        accepted = self.accepted

        def wanted(headers: dict[str, str]) -> bool:
            return all(headers.get(name) in values for name, values in accepted.items())

        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as raw:
                packed = path.endswith(".gz")
                stream = gzip.GzipFile(fileobj=raw) if packed else raw
                with io.BufferedReader(stream if packed else _Raw(raw), 1 << 20) as buffered:
                    for headers, block in records(buffered, wanted):
                        yield self.row(headers, block)

    def row(self, headers: dict[str, str], block: bytes) -> tuple:
        http, payload = http_parts(block)
        stored = headers.get("warc-type") != "revisit"
        digest = headers.get("warc-payload-digest")
        if self.payload and stored and digest and digest.startswith("sha256:"):
            if hashlib.sha256(payload).hexdigest() != digest[7:]:
                raise ValueError(f"payload of {headers.get('warc-record-id')} does not match its digest")
        return (
            *[headers.get(h) for h in HEADER_OF.values()],
            headers,
            http,
            len(payload) if stored else int(http.get("content-length", 0)),
            payload if self.payload and stored else None,
        )


class _Raw(io.RawIOBase):
    """An Arrow stream as a raw Python one."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.stream.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options ``payload`` and ``bundleBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives, one row each; header predicates reach the reader.

    ``payload_bytes`` is the length of the full payload, which a revisit takes from its HTTP
    head; its ``payload`` is null. Stored payloads are held against their digest when decoded.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def index_columns(archive: DataFrame, ident: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest (bare hex), record_type and refers_to of each record.

    A record of no page has neither page_id nor refers_to, as in the SQL twin.
    """
    revisit = (F.col("record_type") == "revisit") & F.col("record_id").startswith("<urn:page:")
    return archive.select(
        page_of(F.col("record_id")).cast(ident).alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type",
        F.when(revisit, page_of(F.col("refers_to")).cast(ident)).alias("refers_to"),
    )
