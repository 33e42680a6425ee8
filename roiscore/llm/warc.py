"""Web archives: WARC files written and read by Spark, and one capture index merged from their sorted runs."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roiscore.llm.common import cut, shared_dir, staged
from roiscore.session import ship

#: Digests of repeated payloads that may be broadcast (about 60 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Records in a file and captures in a range of the merged index, at most.
FILE_RECORDS, RANGE_CAPTURES = 4096, 200_000
#: Payloads of a file (bytes before compression) at most, but for a single larger one; payloads of LARGE_BYTES and more get files of their own.
FILE_BYTES, LARGE_BYTES = 1 << 28, 1 << 18

_END = "\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "url_key string, ts string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long, place long"


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\r\n", *lines)


def records(pages: DataFrame, least_bytes: int = 1000, captured_at: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One WARC record as text (value) for each page, without the blank lines that end it, and the bytes of its payload.

    Of equal payloads of at least least_bytes, the page with the largest id is the response and the others revisit it.
    Pages with a null id are responses; rows with equal ids and payloads have the same type. A null page is an empty payload, a null URL is named after the id.
    """
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    body = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    url = F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"\s", "%20")
    pages = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    shared = cut(pages.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    few = shared.count() <= MOST_BROADCAST
    pages = pages.join(F.broadcast(shared) if few else shared, "digest", "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False)) & (F.col("bytes") >= least_bytes)
    http = F.concat(_lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string"))), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    kind = F.when(revisit, F.concat(F.lit(f"revisit\r\nWARC-Profile: {_REVISIT}\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("response"))
    head = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <"), name, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce("url", name)),
        F.lit(f"WARC-Date: {captured_at}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return pages.select("bytes", F.concat(head, F.lit(_END), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, html_col: str = "html", **options) -> None:
    """WARC files of up to FILE_RECORDS records and FILE_BYTES bytes each, compressed as a whole; an empty table leaves an empty file."""
    size = F.coalesce(F.octet_length(F.col(f"`{html_col}`").cast("string")), F.lit(0))
    longest = pages.agg(F.max(size)).first()[0] or 0
    large = longest >= LARGE_BYTES
    found = records(pages, html_col=html_col, **options)
    for rows, most, mode in ((F.col("bytes") < LARGE_BYTES, min(longest, LARGE_BYTES), "error"), *([(F.col("bytes") >= LARGE_BYTES, longest, "append")] if large else [])):
        written = found.where(rows) if large else found
        per_file = max(1, min(FILE_RECORDS, FILE_BYTES // max(1, most)))
        written.select("value").write.mode(mode).option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then path and query, so that the pages of a host and its subdomains sort together."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    port = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _unpacked(content) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset and length in the unpacked file, header, block) of each record of a compressed file, by declared lengths."""
    data, at, offset, unzip = bytearray(), 0, 0, zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, unzip
        if unzip.eof and unzip.unused_data:
            left, unzip = unzip.unused_data, zlib.decompressobj(31)
            data.extend(unzip.decompress(left))
            return True
        if at >= len(content):
            return False
        data.extend(unzip.decompress(content[at : at + (1 << 18)]))
        at += 1 << 18
        return True

    while True:
        while (stop := data.find(b"\r\n\r\n")) < 0:
            if not more():
                if data.strip():
                    raise ValueError("a record is cut off")
                return
        first, *lines = data[:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a record does not start with its version")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        end = stop + 4 + int(head["content-length"])
        while len(data) < end + 4:
            if not more():
                raise ValueError("a record is cut off")
        yield offset, end, head, bytes(data[stop + 4 : end])
        offset += end + 4
        del data[: end + 4]


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of each archive file as a run that is sorted by URL key, time and id (column `place`).

    Digests of responses are taken from the payloads that were read and held against the headers.
    """
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, length, head, block in _unpacked(memoryview(content.as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: the payload at {offset} does not have its digest")
                    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
                    refers = _page(head["warc-refers-to"]) if "warc-refers-to" in head else None
                    rows.append((url_key(head["warc-target-uri"]), head["warc-date"], _page(head["warc-record-id"]), kind, size, digest, refers, path, offset, length))
                rows.sort(key=_order)
                columns = [*zip(*rows)] if rows else [()] * 10
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in CAPTURES.split(", ")]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array(range(len(rows)), pa.int64())], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content").mapInArrow(read, CAPTURES)


def _order(row: tuple) -> tuple:
    """URL key, time and id; a null id comes first."""
    return row[0].encode(), row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """Merges k sorted sequences; each inner node keeps the loser of its match, so a new head plays one match on each level."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._next(i)
        self.winner = self._play(1) if self.k > 1 else 0

    def _next(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; finished runs go last, ties by the run's number."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            win = self.winner
            yield self.heads[win]
            self._next(win)
            node = (win + self.k) // 2
            while node:
                if self._before(self.losers[node], win):
                    win, self.losers[node] = self.losers[node], win
                node //= 2
            self.winner = win


def merged_index(captures: DataFrame) -> DataFrame:
    """All captures in one order by URL key, time and id, over ranges of that order (one partition each, in order).

    Each range gets its part of every run and merges these by a loser tree. A range holds about RANGE_CAPTURES rows
    however many captures one URL or host has, as ids are part of the order.
    """
    captures = staged(captures)
    ranges = max(1, -(-captures.count() // RANGE_CAPTURES))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(row[7], []).append(row)
        out: list[tuple] = []
        for row in LoserTree([*runs.values()], _order):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    dealt = captures.repartitionByRange(ranges, "url_key", "ts", "page_id").sortWithinPartitions("archive", "place")
    return dealt.mapInArrow(merge, CAPTURES)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Pages written as WARC files to a folder (in the shared folder where none is given), read back, as the merged index.

    Columns: url_key, ts, page_id, record_type, payload_bytes, payload_digest (both of the whole payload), refers_to, and
    where the record lies: archive, offset and length in the unpacked file. An empty table gives no rows; extra columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder, **options)
    return merged_index(read_archives(spark, folder)).drop("place")
