"""WARC archives of pages and a globally ordered capture index.

Writing: Spark groups pages by payload digest (an aggregate that combines before it
shuffles), a join by page marks which pages revisit another, and Spark's text writer puts
one WARC record after another into gzip files; the record separator is its line separator,
so files can go to any store that Spark writes to.  Pages are written by classes of payload
size with fewer records to a file the larger they are: an archive holds at most
``ARCHIVE_BYTES`` of payload, or one record.

Index: each archive is read back and parsed in one task, which checks every payload
against its digest and sorts the captures of the archive by URL key, timestamp and page:
a locally sorted run, written to the shared folder.  The runs are dealt out by ranges of the
whole sort key, so a URL or host with very many captures spreads over tasks, and each range
merges its parts of all runs with a loser tree.  There are as many ranges as the number of
captures asks for, about ``RANGE_ROWS`` in each: a range's part of the runs is held as Arrow
columns, of which the tree decodes a few rows a run at a time.  Range by range, the result is
one capture history for each URL key in global order.

Edge cases: a null payload is empty and a null URL has the empty key; line breaks in URLs
are percent-encoded; payloads under ``MIN_REVISIT`` bytes are always responses; rows that
repeat the largest page id of a payload are all responses, other pages with that payload
revisit it, also those with a null id; payloads whose pages all have a null id are
responses; other columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import map_arrow, new_path, written

MIN_REVISIT = 1000
ARCHIVE_BYTES = 256 << 20       # of payload in an archive, unless it is a single record
RECORDS_A_FILE = 4096           # of the smallest class; each next class has payloads 16 times as large
RANGE_ROWS = 200_000            # captures of a merged range, about
CURSOR_ROWS = 256               # captures of a run that a merge decodes at a time
END = "\r\n\r\n"


def _bytes(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def records(pages: DataFrame, captured_at: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_revisit: int = MIN_REVISIT, sizes: tuple[int, int] | None = None) -> DataFrame:
    """One WARC record for each page, as the string column ``value``; ``sizes`` selects payloads over
    its first and up to its second number of bytes (equal payloads are in one class)."""
    payload = _bytes(F.col(html_col))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), captured_at.alias("at"),
                       payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    if sizes:
        own = own.where((F.col("size") > sizes[0]) & (F.col("size") <= sizes[1]))
    digests = own.select("id", "digest", "size").where(F.col("size") >= min_revisit)
    shared = (digests.groupBy("digest", "size").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
              .where(F.col("refers_to").isNotNull() & (F.col("n") > 1)).drop("n"))
    revisits = (digests.join(shared, ["digest", "size"]).where(~F.col("id").eqNullSafe(F.col("refers_to")))
                .select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to").distinct())
    marked = own.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    maybe = lambda when, text: F.when(when, text).otherwise(F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    body = F.when(is_revisit, F.lit(0)).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.date_format(F.col("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        maybe(F.col("url").isNotNull(), line("WARC-Target-URI", url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        maybe(F.col("id").isNotNull(), line("X-Page-Id", F.col("id").cast("string"))),
        maybe(is_revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
                                   line("WARC-Refers-To", name(F.col("refers_to"))), line("X-Refers-To-Page", F.col("refers_to").cast("string")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + body).cast("string")), F.lit("\r\n"), http)
    return marked.select(F.concat(head.cast("binary"), F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))).cast("string").alias("value"))


def size_classes(most: int = ARCHIVE_BYTES, records_a_file: int = RECORDS_A_FILE) -> list[tuple[int, int, int]]:
    """Classes ``(low, high, records)``: payloads over ``low`` and up to ``high`` bytes, and how many go to a file."""
    out, low = [], -1
    while records_a_file > 1:
        out.append((low, most // records_a_file, records_a_file))
        low, records_a_file = most // records_a_file, records_a_file // 16
    return [*out, (low, (1 << 31) - 1, 1)]


def write_archives(pages: DataFrame, path: str, captured_at: Column, archive_bytes: int = ARCHIVE_BYTES,
                   html_col: str = "html", **columns) -> None:
    """Gzip WARC files of all pages below ``path``, in one write for each class of sizes that occurs."""
    classes = size_classes(archive_bytes)
    size = F.octet_length(_bytes(F.col(html_col)))
    fits = [(size > low) & (size <= high) for low, high, _ in classes]
    found = pages.agg(*(F.max(f).alias(f"k{k}") for k, f in enumerate(fits))).first()
    for k, (low, high, most) in enumerate(classes):
        if found[k] or not (k or any(found)):        # of an empty table, an empty folder
            (records(pages, captured_at, html_col=html_col, sizes=(low, high), **columns).write.option("lineSep", END)
             .option("compression", "gzip").option("maxRecordsPerFile", most).mode("append").text(path))


def parse(content: bytes) -> Iterator[dict]:
    """The records of one gzip WARC file; payloads are held against their digests."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)
    offset = 0
    while version := stream.readline():
        if version != b"WARC/1.0\r\n":
            raise ValueError(f"no WARC record at byte {offset}: {version[:20]!r}")
        size, headers = len(version), {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.decode("utf-8").partition(": ")
            headers[key] = value.removesuffix("\r\n")
            size += len(line)
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(len(END)) != END.encode():
            raise ValueError(f"the WARC record at byte {offset} does not end where it says")
        size += 2 + len(block) + len(END)
        http, _, payload = block.partition(END.encode())
        length = int(http.rpartition(b"Content-Length: ")[2])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"the payload of the WARC record at byte {offset} does not have its digest")
        yield {"urlkey": url_key(headers.get("WARC-Target-URI", "")), "captured_at": headers["WARC-Date"],
               "page": headers.get("X-Page-Id"), "payload_bytes": length, "payload_digest": digest,
               "record_type": headers["WARC-Type"], "refers": headers.get("X-Refers-To-Page"), "offset": offset, "size": size}
        offset += size


def url_key(url: str) -> str:
    """Host with its labels reversed, then path and sorted query: ``org,example)/a?x=1``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    port = f":{port}" if port not in (None, 80, 443) else ""
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + query if query else ''}"


_RUN = [("run", pa.string()), ("urlkey", pa.string()), ("captured_at", pa.string()), ("page", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("offset", pa.int64()), ("size", pa.int64())]
_RUN_SQL = ("run string, urlkey string, captured_at string, page string, payload_bytes long, payload_digest string, "
            "record_type string, refers string, offset long, size long")
_KEY = ["urlkey", "captured_at", "page", "run", "offset"]


def _key(urlkey: str, captured_at: str, page: str | None, run: str, offset: int) -> tuple:
    """As Spark orders ``_KEY``: a null page first; strings by their UTF-8 bytes, as code points."""
    return urlkey, captured_at, page is not None, page or "", run, offset


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below ``path``, each archive's in the order of its index run."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = sorted(({"run": name.rpartition("/")[2], **r} for r in parse(content.as_buffer().to_pybytes())),
                              key=lambda r: _key(*(r[n] for n in _KEY)))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _RUN], names=[n for n, _ in _RUN])

    archives = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return map_arrow(archives, read, _RUN_SQL)


def loser_tree(runs: list[Iterable]) -> Iterator[tuple[int, int]]:
    """Merge sorted runs: ``(run, index)`` in order, ties by run.  Runs are read once, one key
    ahead.  Each inner node keeps the loser of its match, so a step plays one match for each level."""
    k, at = len(runs), [0] * len(runs)
    cursors = [iter(run) for run in runs]
    heads = [next(c, None) for c in cursors]

    def wins(a: int, b: int) -> bool:
        if heads[a] is None:
            return False
        return heads[b] is None or (heads[a], a) < (heads[b], b)

    best, losers = [0] * k + list(range(k)), [0] * k
    for node in range(k - 1, 0, -1):
        a, b = best[2 * node], best[2 * node + 1]
        best[node], losers[node] = (a, b) if wins(a, b) else (b, a)
    winner = best[1] if k else 0
    while k and heads[winner] is not None:
        yield winner, at[winner]
        at[winner] += 1
        heads[winner] = next(cursors[winner], None)
        node = (k + winner) // 2
        while node:
            if wins(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order: ``part`` counts ranges, ``pos`` places within one."""
    def cursor(table: pa.Table, start: int, stop: int) -> Iterator[tuple]:
        for at in range(start, stop, CURSOR_ROWS):
            few = table.slice(at, min(CURSOR_ROWS, stop - at))
            yield from map(_key, *(few.column(n).to_pylist() for n in _KEY))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [batch for batch in batches if batch.num_rows]      # run by run, each in its order
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        got.clear()
        code = table.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
        edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
        part, places, pos = TaskContext.get().partitionId(), [], 0
        for r, i in loser_tree([cursor(table, a, b) for a, b in zip(edges, edges[1:])]):
            places.append(edges[r] + i)
            if len(places) == 10_000:
                yield taken(table, places, part, pos)
                pos, places = pos + len(places), []
        if places:
            yield taken(table, places, part, pos)

    def taken(table: pa.Table, places: list[int], part: int, pos: int) -> pa.RecordBatch:
        rows, n = table.take(pa.array(places, pa.int64())), len(places)
        columns = [rows.column(name).combine_chunks().cast(kind) for name, kind in _RUN]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(pos, pos + n))],
                                          names=[*(name for name, _ in _RUN), "part", "pos"])

    ranges = max(-(-runs.count() // range_rows), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartitionByRange(ranges, *_KEY).sortWithinPartitions("run", *_KEY)
    return map_arrow(dealt, merge, _RUN_SQL + ", part long, pos long")


def capture_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Captures of the archives below ``path`` with ``rank``, their place in the global order by
    URL key, time and page: ``rank, urlkey, captured_at, page_id, payload_bytes, payload_digest,
    record_type, refers_to, archive, offset, size``."""
    merged = written(merge_runs(written(sorted_runs(spark, path), "index-runs")), "index")
    totals = sorted((r["part"], r["n"]) for r in merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    base, rows = 0, []
    for part, n in totals:                      # one row for each range
        rows.append((part, base))
        base += n
    bases = spark.createDataFrame(rows, "part long, base long")
    return merged.join(bases, "part").select(
        (F.col("base") + F.col("pos")).alias("rank"), "urlkey", "captured_at", F.col("page").cast(id_type).alias("page_id"),
        "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"),
        F.col("run").alias("archive"), "offset", "size")


def archive_pages(pages: DataFrame, captured_at: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as WARC files to the shared folder, read them back, index them."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, captured_at, archive_bytes, id_col=id_col, url_col=url_col, html_col=html_col, min_revisit=min_revisit)
    return capture_index(spark, path, pages.schema[id_col].dataType.simpleString())
