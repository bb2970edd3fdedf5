"""WARC archives: writing, reading back, and a capture index merged from sorted runs.

Records are UTF-8 throughout, so Spark's text writer, with the end of a WARC
record as its line separator, writes archives byte for byte through whatever
store the path names; they are read back whole, file by file, by their
Content-Length. Each archive's captures form a locally sorted run; runs are cut
into key ranges, and a task merges the runs of its range with a loser tree by
URL key and timestamp.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import common

#: Payloads of fewer bytes are always stored as responses.
REVISIT_BYTES = 100
#: Payload bytes of one archive, about; it is what a reading task holds.
ARCHIVE_BYTES = 16 << 20
#: Rows of the index in one merging task, about; it holds them, some 600 bytes each.
MERGE_ROWS = 1 << 17
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Capture times are counted in seconds from here where a table has none.
EPOCH = 1_700_000_000


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html, ...) with payload_bytes, payload_digest and refers_to (null: stored as a response).

    The response of a payload is found by an aggregation with partial sums and
    joined back, so a payload that a third of all pages share is never gathered.
    """
    sized = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    keys = sized.select("payload_digest", "payload_bytes", "page_id")
    firsts = keys.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    firsts = common.small(common.save(firsts.select("payload_digest", "first"), "copies"), 96)
    return sized.join(firsts, "payload_digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def records(pages: DataFrame) -> Column:
    """The text of a record but for its last four bytes, over the columns of with_revisits and captured_at."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # with the payload's digest, so that rows with one page_id have records of their own
    urn = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(":"), F.substring("payload_digest", 1, 16), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    again = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(again, _line("WARC-Type", "revisit")).otherwise(_line("WARC-Type", "response")),
        _line("WARC-Record-ID", urn(page)),
        _line("WARC-Date", F.date_format(F.timestamp_seconds("captured_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        # a line end would end the header
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " "))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(again, F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", urn(F.col("refers_to").cast("string"))))).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one record per row of with_revisits (and captured_at, seconds) to archives of about archive_bytes under path."""
    total = pages.agg(F.sum("payload_bytes")).first()[0] or 0
    files = max(1, -(-total // archive_bytes))
    # a hash of the row's own id spreads hosts and copies evenly
    spread = pages.repartition(files, F.xxhash64("page_id", "url", "payload_bytes"))
    spread.select(records(spread).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the right, then path and query, lower case, without scheme, www and fragment."""
    try:
        u = urlsplit(url or "")
        host = re.sub(r"^www\d*\.", "", (u.hostname or "").lower())
        port = f":{u.port}" if u.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    query = "&".join(sorted(u.query.lower().split("&"))) if u.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(u.path or '/').lower()}{'?' + query if query else ''}"


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield at, head, data[end + 4 : stop]
        at = stop + 4


INDEX = "archive string, pos long, url_key string, captured_at string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under path, one locally sorted run per archive (columns INDEX); pos is a record's first byte in the unpacked archive.

    A response's payload must have the digest its header names.
    """
    import zlib

    def number(urn: str | None) -> int | None:
        body = urn[len("<urn:page:") : -1].split(":")[0] if urn else ""
        return int(body) if body else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, data = [], zlib.decompress(packed.as_buffer(), 31)
                for at, head, block in parse(data):
                    cut = block.index(b"\r\n\r\n")
                    http = dict(x.split(": ", 1) for x in block[:cut].decode().split("\r\n")[1:])
                    size, digest, payload = int(http["Content-Length"]), head["warc-payload-digest"].removeprefix("sha256:"), block[cut + 4 :]
                    kind = head["warc-type"]
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: the payload at byte {at} isn't the one that was stored")
                    url = head.get("warc-target-uri")
                    rows.append((url_key(url), head["warc-date"], number(head["warc-record-id"]), at, url, size, digest, kind, number(head.get("warc-refers-to"))))
                rows.sort(key=_order)
                cols = list(zip(*rows, strict=True)) or [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(rows), pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.string()), pa.array(cols[8], pa.int64())], names=[x.split()[0] for x in INDEX.split(", ")])

    common.bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


def _order(row: tuple) -> tuple:
    """Order of captures: URL key, timestamp, page (none first)."""
    return row[0], row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so the next item costs one path of log2(k) comparisons."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _replay(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # the first to come waits here for its opponent
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k:
            i = self.losers[0]
            if self.heads[i] is None:
                return
            yield self.heads[i][1]
            self.heads[i] = next(self.runs[i], None)
            self._replay(i)


def merge_index(captures: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """Captures in global order of URL key, timestamp and page: partition i holds what precedes partition i + 1.

    Each partition gets a key range of every run, in the run's order, and
    merges them. The page and the record's place are in the key, so one URL
    captured many times is cut like anything else, and a range is of bounded
    size.
    """
    rows = captures.count()
    ranged = captures.repartitionByRange(max(1, -(-rows // merge_rows), min(rows // 1000, captures.sparkSession.sparkContext.defaultParallelism)), "url_key", "captured_at", "page_id", "archive", "pos")
    names = [x.split()[0] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id")), strict=True))
        runs: dict[str, list[int]] = {}
        for i, name in enumerate(table.column("archive").to_pylist()):
            runs.setdefault(name, []).append(i)
        parts = []
        for _, places in sorted(runs.items()):
            # a run's blocks arrive in its order unless a fetch was retried
            order = [_order(keys[i]) for i in places]
            if any(a > b for a, b in zip(order, order[1:], strict=False)):
                places = [places[i] for i in sorted(range(len(places)), key=order.__getitem__)]
            parts.append(((_order(keys[i]), i) for i in places))
        order = np.fromiter(LoserTree(parts), np.int64, len(table))
        yield from table.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=10_000)

    common.bounded_batches(captures.sparkSession)
    return ranged.select(*names).mapInArrow(run, INDEX)


def archive_pages(pages: DataFrame, path: str, least: int = REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Writes pages to archives under path, reads them back and returns the merged index, one row per page.

    time_col holds seconds; without it, captures are a second apart by page. A
    null html is an empty payload, a null url has no Target-URI, a null page_id
    an empty page in its record id (such a page is always a response). Repeated
    page_ids give a row each; of equal payloads, all rows with the smallest
    page_id are responses. Other columns are ignored.
    """
    seconds = F.col(time_col).cast("long") if time_col else F.lit(EPOCH) + F.coalesce(F.col(id_col), F.lit(0)).cast("long")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), seconds.alias("captured_at"))
    write_archives(with_revisits(rows, least), path)
    return merge_index(common.save(read_archives(pages.sparkSession, path), "captures"))
