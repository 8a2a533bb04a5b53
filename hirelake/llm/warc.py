"""WARC archives of pages and the ordered index of their captures.

Writing: of pages with equal payloads the one with the least page_id is a response record, the others
are revisits of it. Each task writes gzipped archives to the shared folder, its captures sorted by URL key
and date, under names that no other attempt uses; only archives that a finished task reports are read.

Reading: every archive is parsed record by record, digests are checked, and its captures are a sorted run.
External merge: boundaries from a regular sample of the runs cut all runs into key ranges of like size;
each range merges its pieces of the runs with a loser tree. Ranges follow one another, so a capture's
position is the number of captures before its range plus its place in it.

A null html is an empty payload, a null url has an empty key. Rows that share the least page_id of their
payload are all responses. A null page_id sorts last; if all are null they are responses. An empty table
gives no archives and an empty index.
"""

from __future__ import annotations

import base64
import bisect
import datetime as dt
import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, scratch_path

ARCHIVE_BYTES = 256 << 20
RANGE_ROWS = 1_000  # captures of a key range, until there are MANY_RANGES; then ranges grow, up to MOST_RANGE_ROWS
MANY_RANGES = 16_384
MOST_RANGE_ROWS = 250_000
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LEVEL = 4
NO_ID = 1 << 63


def url_key(url: str | None) -> str:
    """Sortable key of a URL: the host's labels from the top down, then path and query. Scheme, www., port 80/443 and fragment don't count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    if host.startswith("www."):
        host = host[4:]
    end = f":{port}" if port not in (None, 80, 443) else ""
    return ",".join(reversed(host.split("."))) + end + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_date(page_id: int | None) -> str:
    """The pages have no dates: a page is taken to be captured page_id seconds after the start of 2024."""
    return (EPOCH + dt.timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def order_key(url: str, date: str, page_id: int | None) -> str:
    return f"{url}\x00{date}\x00{(NO_ID if page_id is None else page_id) + NO_ID:020d}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP head of its full payload and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {capture_date(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%-._"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _page(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").rpartition(":")[2]
    return int(name) if name else None


def parse(data: bytes) -> dict:
    """The fields of one record; its payload must have the digest it states."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).partition(":")[2])
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    kind = field["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {field['warc-record-id']}")
    return {"page_id": _page(field["warc-record-id"]), "url_key": url_key(field.get("warc-target-uri")), "date": field["warc-date"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page(field.get("warc-refers-to"))}


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member, read in steps."""
    at, engine, parts, size = 0, zlib.decompressobj(31), [], 0
    chunk = stream.read(1 << 20)
    while chunk:
        parts.append(engine.decompress(chunk))
        size += len(chunk) - len(engine.unused_data)
        chunk = engine.unused_data
        if engine.eof:
            yield at, size, b"".join(parts)
            at, engine, parts, size = at + size, zlib.decompressobj(31), [], 0
        chunk = chunk or stream.read(1 << 20)
    if size:
        raise ValueError("archive ends inside a record")


class LoserTree:
    """Merges sorted iterators of (key, value): each inner node keeps the loser of its match, the winner goes on."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k - 1, -1, -1):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.tree[0]]) is not None:
            yield head
            i = self.tree[0]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                member = gzip.compress(record(page.as_py(), url.as_py(), payload, refers.as_py()), LEVEL, mtime=0)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done.append((name, count))
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["archive", "records"])

    return run


_CAPTURE = "archive string, seq long, offset long, length long, order_key string, url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(folder: str):
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in _CAPTURE.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for offset, length, data in members(stream):
                        f = parse(data)
                        rows.append({"archive": archive, "seq": seen, "offset": offset, "length": length, "order_key": order_key(f["url_key"], f["date"], f["page_id"]), **{k: v for k, v in f.items() if k != "date"}})
                        seen += 1
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if seen != records:
                    raise ValueError(f"{archive} holds {seen} of {records} records")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls, pages = batch.column("url").to_pylist(), batch.column("page_id").to_pylist()
        quoted = [None if u is None else quote(u, safe="!#$&'()*+,/:;=?@[]~%-._") for u in urls]
        keys = pa.array([order_key(url_key(u), capture_date(p), p) for u, p in zip(quoted, pages, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "order_key"])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one record per row of `pages` (page_id, url, html) and gives the archives: archive, records."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.unhex(F.sha1(F.coalesce("html", F.lit("")))).alias("sha1"))
    # written first: a join right after the exchange of an aggregate could not be split where one payload has very many pages
    least = materialise(d.groupBy("sha1").agg(F.min("page_id").alias("least")), "warc-payloads")
    d = d.join(least, "sha1").withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("least"), F.col("least").isNotNull()), F.col("least")))
    d = d.select("page_id", "url", "html", "refers_to")
    schema = "page_id long, url string, html string, refers_to long, order_key string"
    sorted_ = d.mapInArrow(_keys, schema).sortWithinPartitions("order_key")
    jvm = pages.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return materialise(sorted_.mapInArrow(_writer(folder), "archive string, records long"), "warc-archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record, each archive a run in the order of its captures."""
    n = max(1, archives.count())
    return archives.repartition(n, "archive").mapInArrow(_reader(folder), _CAPTURE)


def merge_index(captures: DataFrame) -> DataFrame:
    """Adds `position`, gapless from 0 in the order of URL key, date and page_id, to captures that come in sorted runs."""
    total = captures.count()
    n = max(1, math.ceil(total / min(max(RANGE_ROWS, math.ceil(total / MANY_RANGES)), MOST_RANGE_ROWS)))
    # every step-th capture of each run, from a place of the run's own, so that short runs count as well
    step = max(1, total // (32 * n))
    sample = sorted(r["order_key"] for r in captures.filter(F.col("seq") % step == F.pmod(F.xxhash64("archive"), F.lit(step))).select("order_key").collect())
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def place(keys):
        return keys.map(lambda k: bisect.bisect_right(cuts, k)).astype("int64")

    d = captures.withColumn("_range", F.pandas_udf(place, "long")("order_key"))
    counts = {r["_range"]: r["count"] for r in d.groupBy("_range").count().collect()}
    first, below = {}, 0
    for i in range(len(cuts) + 1):
        first[i], below = below, below + counts.get(i, 0)

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("archive", "ascending"), ("seq", "ascending")])  # brings the pieces of each run together; they are sorted already
        keys, names = rows["order_key"].to_pylist(), rows["archive"].to_pylist()
        edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        runs = [iter([(keys[i], i) for i in range(a, b)]) for a, b in zip(edges, edges[1:], strict=False)]
        order = [i for _, i in LoserTree(runs)]
        out = rows.take(pa.array(order, pa.int64()))
        start = first[out["_range"][0].as_py()]
        return out.append_column("position", pa.array(range(start, start + len(order)), pa.int64())).drop_columns(["_range"])

    return d.groupBy("_range").applyInArrow(merge, _CAPTURE + ", position long")


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and gives the merged index of all captures."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    captures = materialise(read_archives(write_archives(pages, uri), uri), "warc-captures")
    return merge_index(captures)
