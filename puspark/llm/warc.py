"""WARC archives: written by Spark's text writer, read back by a Python data source.

Writing: one record per page, as text, so any file system that Spark reaches will do, and a lost executor's files are
written again by Spark's commit protocol. Records of equal payload are written once; the others refer to it.

Reading: ``spark.read.format("warc").load(path)``. Files are dealt out to partitions of about equal size. Headers are
parsed first; filters on record type and other headers that Spark pushes down are judged there, and payloads of other
records are skipped without being read. ``option("payload", "false")`` skips all payloads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from puspark.sources.shared import materialise

#: Payloads below this many bytes are always written.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PARTITION_BYTES = 64 << 20
_UNSAFE = "%\x00-\x20\x7F"


def judged(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads of ``least`` bytes or more, those with the largest page_id are responses (all of them
    if it is on several rows), the others refer to it. Rows with a null id are responses only if no row has an id.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8")))
    last = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    last = last.agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 and last_id is not null").drop("n")
    last = materialise(last)  # of known size: where it is small, Spark joins it without moving the payloads
    rows = rows.join(last.withColumnsRenamed({"payload_digest": "d", "payload_bytes": "b"}), (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return rows.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last_id")).alias("refers_to"),
    )


def _escaped(column: Column) -> Column:
    """White space, controls and % as %XX, so that a value stays on its header line."""
    out = F.replace(column, F.lit("%"), F.lit("%25"))
    for code in [*range(33), 127]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(column.rlike("[\\x00-\\x20%\\x7F]"), out).otherwise(column)


def record(row_url: str = "url") -> Column:
    """The record as text, without its last line feed."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    size = F.octet_length(http) + F.octet_length(body)

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    return F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        header("WARC-Target-URI", _escaped(F.col(row_url))),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        header("WARC-Profile", F.when(F.col("record_type") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        size.cast("string"),
        F.lit("\r\n\r\n"),
        http,
        body,
        F.lit("\r\n\r"),
    )


def write(pages: DataFrame, path: str) -> None:
    """One record per row of ``pages`` (page_id, url, html); null urls and ids leave their headers out."""
    judged(pages).select(record().alias("value")).write.option("lineSep", "\n").text(path)


SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def _value(headers: dict[str, str], column: str) -> str | None:
    raw = headers.get(HEADERS[column])
    if raw is None:
        return None
    if column in ("record_id", "refers_to"):
        return raw.removeprefix("<urn:page:").removesuffix(">")
    if column == "payload_digest":
        return raw.removeprefix("sha1:")
    return unquote(raw) if column == "target_uri" else raw


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.size = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            kept = isinstance(f, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS
            if kept:
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, headers: dict[str, str]) -> bool:
        for f in self.tests:
            value = _value(headers, f.attribute[0])
            if isinstance(f, IsNull):
                ok = value is None
            elif value is None:
                ok = False
            elif isinstance(f, EqualTo):
                ok = value == f.value
            elif isinstance(f, In):
                ok = value in f.value
            else:
                ok = isinstance(f, IsNotNull) or value.startswith(f.value)
            if not ok:
                return False
        return True

    def _files(self) -> tuple[Any, str]:
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else FileSystem.from_uri(f"file://{quote(self.path)}")

    def partitions(self) -> Sequence[InputPartition]:
        """Files in groups of about ``partitionBytes``; a file is read by one task."""
        from pyarrow.fs import FileSelector

        system, root = self._files()
        groups: list[list[str]] = []
        room = 0
        for info in sorted(system.get_file_info(FileSelector(root)), key=lambda i: i.path):
            if info.is_file and not info.base_name.startswith(("_", ".")) and info.size:
                if room < info.size:
                    groups.append([])
                    room = self.size
                groups[-1].append(info.path)
                room -= info.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._files()
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                yield from self._records(raw)

    def _records(self, raw: Any) -> Iterator[tuple]:
        import io

        stream = io.BufferedReader(raw, 1 << 20)
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}")
            headers = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            if not self._wanted(headers):
                stream.seek(size, io.SEEK_CUR)
                continue
            payload = None
            if self.payload and headers["warc-type"] == "response":
                payload = stream.read(size).partition(b"\r\n\r\n")[2]
            else:
                stream.seek(size, io.SEEK_CUR)
            length = headers.get("warc-payload-length")
            columns = [_value(headers, c) for c in ("record_type", "record_id", "target_uri", "date", "payload_digest")]
            yield (*columns, int(length) if length else None, _value(headers, "refers_to"), payload)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under ``path`` with the columns of ``SCHEMA``; revisits have a null payload. An empty folder has none.

    Turns on the session's setting for filters pushed down to Python data sources.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
