"""Web archives: writing WARC files, reading them back, and capture histories in global order.

Each writing task makes gzipped archives, one member per record. Reading an archive gives one locally
sorted run of index entries by URL key and timestamp. For histories the runs are dealt out by key
range; each task merges its part of all runs with a loser tree, so that the parts in order are the
global order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm.common import scratch, staged, values

_END = b"\r\n\r\n"
#: Capture time of page n where pages have none: n seconds (modulo about 30 years) after 2000.
_EPOCH, _SPAN = 946_684_800, 1_000_000_000
_MISSING = "missing"
INDEX = (
    "url_key string, captured timestamp, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint, archive string, offset bigint, length bigint"
)


def url_key(url: str | None) -> str:
    """Host with its labels reversed, then path and query; the fragment and the scheme do not count."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f"){url}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path.lower() or '/'}{query}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=page_id & (2**64 - 1))}>" if page_id is not None else f"<urn:{_MISSING}>"


def _page_id(record_id: str | None) -> int | None:
    if not record_id or _MISSING in record_id:
        return None
    value = uuid.UUID(record_id[10:-1]).int
    return value - 2**64 if value >= 2**63 else value


def record(page_id: int | None, url: str | None, date: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit has the header of the answer and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    block = http if revisit else http + payload
    uri = re.sub(r"[\r\n]+", " ", url) if url is not None else ""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_record_id(refers_to)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + _END + block + _END) + packer.flush()


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record."""
    view, at = memoryview(archive), 0
    while at < len(view):
        unpacker = zlib.decompressobj(31)
        parts, ahead = [], at
        while not unpacker.eof and ahead < len(view):
            parts.append(unpacker.decompress(view[ahead : ahead + 65_536]))
            ahead += 65_536
        if not unpacker.eof:
            raise ValueError("an archive ends within a record")
        end = min(ahead, len(view)) - len(unpacker.unused_data)
        head, _, rest = b"".join(parts).partition(_END)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield at, end - at, fields, rest[: int(fields["Content-Length"])]
        at = end


def _with_originals(pages: DataFrame, least: int) -> DataFrame:
    """Add ``_first``: the smallest id among pages of equal payload, where there are several."""
    html = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", F.sha1(F.encode(html, "UTF-8")).alias("_sha"), F.octet_length(html).alias("_size"))
    slim = slim.where(F.col("_size") >= least)
    groups = slim.groupBy("_sha", "_size").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    groups = groups.where("_n > 1").drop("_n")
    again = slim.join(groups, ["_sha", "_size"]).where(~F.col("page_id").eqNullSafe(F.col("_first")))
    again = again.select(F.col("page_id").alias("_id"), F.col("_sha").alias("_again"), "_first").distinct()
    return pages.join(
        again,
        F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha1(F.encode(html, "UTF-8")) == F.col("_again")),
        "left",
    )


def write(pages: DataFrame, folder: str, least: int = 0, most_bytes: int = 32 << 20) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)``; the manifest of the archives made.

    ``folder`` is a URI or path that all executors reach. An archive gets its name from the attempt
    that wrote it and counts only if the manifest has it, so that attempts that were lost or ran
    twice leave nothing behind that is read. A null html is an empty payload. Of equal payloads of
    ``least`` bytes or more the smallest id is the response and others revisit it; rows that share
    that id are all responses, and rows without id revisit if any row has one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        held, size, count = [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"part-{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for part in held:
                    out.write(part)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [size]})

        store.create_dir(root, recursive=True)
        for batch in batches:
            for page_id, url, date, html, first, again in zip(*(values(c, 64) for c in batch.columns)):
                made = record(page_id, url, date, (html or "").encode("utf-8", "surrogatepass"), first, again)
                held.append(made)
                size, count = size + len(made), count + 1
                if size >= most_bytes:
                    yield flush()
                    held, size, count = [], 0, 0
        if held:
            yield flush()

    seconds = _EPOCH + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(_SPAN))
    date = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = _with_originals(pages.select("page_id", "url", "html"), least).select(
        "page_id", "url", date.alias("date"), "html", "_first", F.col("_again").isNotNull()
    )
    return staged(rows.mapInArrow(run, "archive string, records bigint, bytes bigint"), "manifest")


def _entries(name: str, archive: bytes) -> list[tuple]:
    out = []
    for offset, length, fields, block in records(archive):
        http, _, payload = block.partition(_END)
        again = fields["WARC-Type"] == "revisit"
        size = int(http.rpartition(b"Content-Length: ")[2]) if again else len(payload)
        told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if not again and digest(payload) != told:
            raise ValueError(f"{name} at {offset}: the payload has another digest")
        url = fields["WARC-Target-URI"]
        page = _page_id(fields["WARC-Record-ID"])
        back = _page_id(fields.get("WARC-Refers-To")) if again else None
        out.append((url_key(url), fields["WARC-Date"], page, url, size, told, fields["WARC-Type"], back, name, offset, length))
    return sorted(out, key=lambda r: (r[0], r[1], r[8], r[9]))


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Index entries (``INDEX``) of all records in the archives of the manifest, a sorted run from each."""
    names = [f.name for f in spark.createDataFrame([], INDEX).schema]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows = _entries(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    if manifest.isEmpty():
        return spark.createDataFrame([], INDEX)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    files = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).select("archive", "content")
    files = files.join(manifest.select("archive"), "archive", "left_semi")
    text = INDEX.replace("captured timestamp", "captured string")
    return files.mapInArrow(run, text).withColumn("captured", F.to_timestamp("captured"))


def merge(runs: list[list]) -> Iterable:
    """k-way merge of sorted runs of comparable items by a loser tree.

    The inner nodes hold the losers of the matches below them; after the winner is taken, only the
    matches on its way to the root are played again. Of equal items the earlier run's comes first.
    """
    runs = [r for r in runs if r]
    k = len(runs)
    if k == 0:
        return
    iterators = [iter(r) for r in runs]
    head: list = [(next(it), i) for i, it in enumerate(iterators)]
    tree = [-1] * k  # tree[0] is the winner

    def play(leaf: int) -> None:
        winner, node = leaf, (leaf + k) // 2
        while node > 0:
            rival = tree[node]
            if rival == -1:
                tree[node] = winner
                return
            if head[rival] is not None and (head[winner] is None or head[rival] < head[winner]):
                tree[node], winner = winner, rival
            node //= 2
        tree[0] = winner

    for leaf in range(k):
        play(leaf)
    while head[tree[0]] is not None:
        leaf = tree[0]
        yield head[leaf][0]
        following = next(iterators[leaf], None)
        head[leaf] = None if following is None else (following, leaf)
        play(leaf)


def histories(entries: DataFrame, parts: int | None = None) -> DataFrame:
    """The entries with ``part`` and ``place``: by these two they are in order of URL key and time.

    A range of keys goes to one part; a key with many captures is spread over several parts by time
    and id. A null id sorts first.
    """
    order = ["url_key", "captured", "page_id", "archive", "offset"]
    schema = f"{INDEX}, place bigint"
    names = entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        columns = {n: table[n].to_pylist() for n in order}
        by_run: dict[str, list] = {}
        for i, name in enumerate(columns["archive"]):
            page = columns["page_id"][i]
            key = (columns["url_key"][i], columns["captured"][i], page is not None, page or 0, name, columns["offset"][i], i)
            by_run.setdefault(name, []).append(key)
        # The pieces of a run come in its order from each block; a run that several blocks bring is sorted again.
        merged = [key[-1] for key in merge([sorted(r) for _, r in sorted(by_run.items())])]
        out = table.take(pa.array(merged)).combine_chunks()
        out = out.append_column("place", pa.array(range(len(out)), pa.int64()))
        yield from out.to_batches()

    keys = [F.col(c) for c in order]
    dealt = entries.repartitionByRange(parts, *keys) if parts else entries.repartitionByRange(*keys)
    return dealt.mapInArrow(run, schema).withColumn("part", F.spark_partition_id())


def captures(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write all pages, read the archives back, and return their capture histories in global order."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    manifest = write(pages, folder, least)
    return histories(read(spark, folder, manifest))
