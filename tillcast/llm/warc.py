"""WARC archives of pages, and their global capture index by external merging.

Pages become WARC/1.1 records: a response with its payload, or a revisit that names the
response of an equal payload. Spark's text writer stores them with the record end as line
separator, which is exactly the archive format, so its committer makes the files safe against
lost executors and any store that Spark writes can hold them.

Reading back follows the Content-Length fields, checks every payload against its digest, and
gives one sorted run of captures for every archive. The runs are merged into the global
index: ranges of (URL key, time, page, place) are dealt out by sampled bounds, so one hot URL or
host spreads over many ranges, and in each range a loser tree merges the pieces of all runs.

Of pages with equal payloads of ``least`` bytes or more, those with the smallest page_id are
responses and the others revisits; rows that repeat that smallest page_id are responses too.
Null payloads are empty. A null URL has an empty key. A payload may hold any text, also one
that looks like a record. No page is dropped; other columns are not read. An empty table
gives an empty index.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillcast.session import materialize, scratch_path

END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive, and captures of a range of the index.
ARCHIVE_BYTES = 32 << 20
RANGE_ROWS = 100_000
#: Repeated digests up to which their list is sent to every task: about 100 bytes each.
BROADCAST_DIGESTS = 500_000

INDEX = (
    "urlkey string, captured string, page_id long, archive string, place long, length long, "
    "record_type string, refers_to long, payload_bytes long, payload_digest string"
)
_KEY = ("urlkey", "captured", "page_id", "archive", "place")


def _captured(pages: DataFrame) -> Column:
    """The capture time, where a table has none: one second a page from a fixed day on."""
    if "captured" in pages.columns:
        return F.col("captured").cast("timestamp_ntz")
    return F.expr(
        "timestampadd(SECOND, pmod(coalesce(page_id, 0L), 1000000000L), TIMESTAMP_NTZ'2024-01-01 00:00:00')"
    )


def records(pages: DataFrame, least: int = 100) -> DataFrame:
    """One column, ``value``: the records of all pages without their ends."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\s\p{Cntrl}]", "%20").alias("url"),
        F.coalesce(F.date_format(_captured(pages), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z")).alias("captured"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    # the pages are combined before the shuffle; only digests that occur twice go into the join
    firsts = (
        rows.where(F.col("n") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    )
    firsts = materialize(firsts, "firsts")
    if firsts.count() <= BROADCAST_DIGESTS:  # then no payload is moved
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value.cast("string")), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("n").cast("string"), F.lit(END),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    unique = F.md5(F.concat_ws("|", "page_id", "url", F.monotonically_increasing_id()))
    uuid = F.regexp_replace(unique, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return rows.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))),
            line("WARC-Date", F.col("captured")),
            line("WARC-Target-URI", F.col("url")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}\r\n")).otherwise(""),
            F.when(revisit, optional("X-Refers-To-Page", F.col("first"))).otherwise(""),
            optional("X-Page", F.col("page_id")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"), block,
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, least: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the archives below ``path``; their size follows from the mean size of a page."""
    mean = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    most = max(1, int(archive_bytes // (mean + 600)))
    records(pages, least).write.option("lineSep", END).option("maxRecordsPerFile", most).text(path)
    return path


def url_key(url: str) -> str:
    """The host from its last label on, then path and query, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return (",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query).lower()


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(place, length, fields, payload) of every record of an archive."""
    at, view = 0, memoryview(content)
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        first, *lines = bytes(view[at:head_end]).decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}: {first[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        start = head_end + 4
        stop = start + int(fields["Content-Length"])
        body = content.index(b"\r\n\r\n", start) + 4
        http = re.search(rb"Content-Length: (\d+)", content[start:body])
        fields["payload-bytes"] = http[1].decode()
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it should")
        yield at, stop + 4 - at, fields, bytes(view[body:stop])
        at = stop + 4


def _captures(archive: str, content: bytes) -> Iterator[tuple]:
    for place, length, fields, payload in parse(content):
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["payload-bytes"])
        if fields["WARC-Type"] == "response":
            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                raise ValueError(f"{archive} at {place}: the payload differs from its digest")
        number = lambda name: int(fields[name]) if name in fields else None  # noqa: E731, B023
        yield (
            url_key(fields["WARC-Target-URI"]), fields["WARC-Date"], number("X-Page"), archive, place,
            length, fields["WARC-Type"], number("X-Refers-To-Page"), size, digest,
        )


def _sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
    )


_SCHEMA = pa.schema([
    (name, pa.int64() if kind == "long" else pa.string())
    for name, kind in (field.split(" ") for field in INDEX.split(", "))
])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives, every archive's sorted: the runs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                archive = name.as_py().rsplit("/", 1)[-1]
                rows = sorted(_captures(archive, content.as_py()), key=_sort_key)
                for k in range(0, len(rows), 10_000):
                    yield _batch(rows[k : k + 10_000], _SCHEMA)

    return files.select("path", "content").mapInArrow(run, INDEX)


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs; every inner node keeps the loser of its match, the winner goes up.

    Taking a row replays one path to the root: log2(k) comparisons, whatever the runs' lengths.
    """
    k = len(runs)
    if not k:
        return
    streams = [iter(run) for run in runs]
    heads: list[tuple | None] = []
    keys: list[tuple] = []
    last = (1,)  # after every (0, key)
    for stream in streams:
        row = next(stream, None)
        heads.append(row)
        keys.append(last if row is None else (0, _sort_key(row)))
    losers = [0] * k
    # leaves are k .. 2k-1; winners[i] is the run that wins below node i
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
    champion = winners[1] if k > 1 else 0
    while heads[champion] is not None:
        yield heads[champion]
        row = next(streams[champion], None)
        heads[champion] = row
        keys[champion] = last if row is None else (0, _sort_key(row))
        node = (champion + k) // 2
        while node:
            if keys[losers[node]] < keys[champion]:
                losers[node], champion = champion, losers[node]
            node //= 2


def _pieces(rows: Iterable[tuple]) -> list[list[tuple]]:
    """The rows of each archive, in order; a shuffle may have changed the order of its blocks."""
    runs: dict[str, list[tuple]] = {}
    for row in rows:
        runs.setdefault(row[3], []).append(row)
    for run in runs.values():
        if any(_sort_key(b) < _sort_key(a) for a, b in zip(run, run[1:])):
            run.sort(key=_sort_key)
    return list(runs.values())


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The global index: partitions in order of their ranges, rows in order inside each.

    ``ordinal`` grows along that order over the whole index.
    """
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, *_KEY)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        out = []
        for row in loser_tree(_pieces(rows)):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out, _SCHEMA)
                out = []
        if out:
            yield _batch(out, _SCHEMA)

    return dealt.mapInArrow(merge, INDEX).withColumn("ordinal", F.monotonically_increasing_id())


def archive_index(pages: DataFrame, least: int = 100, archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write the archives into the shared folder, read them back and merge their runs."""
    spark = pages.sparkSession
    path = write_archives(pages, scratch_path(spark, "archives"), least, archive_bytes)
    return merge_runs(materialize(read_runs(spark, path), "runs"), range_rows)
