"""WARC archives with a two-level capture index.

Records are gzip members, one a record, gathered into archive segments of about
``SEGMENT_BYTES``; the concatenation of a segment's members is a valid .warc.gz file. Segments
and index live in tables, whose binary columns Spark writes to any store; ``export`` writes
the segments as files where there is a file system to take them.

The index is sorted by reversed-host key (``com,example,www)/path``), page id last, and cut
into compressed blocks of ``BLOCK_ROWS`` captures, or of more where there would be over ``MOST_BLOCKS``; a
sparse directory has each block's first and last key, and so is bounded. A lookup searches the directory
by bisection, reads the blocks that can hold the key, searches within, and reads the record's range of
its segment. Many lookups go the same way at once: each key is bisected in the broadcast directory, keys
meet their blocks, are bisected there, and the places found meet their segments.

Of records with equal payloads of ``revisit_from`` bytes and more, the one with the largest page
id is the response; others are revisits that refer to it and hold no payload. Equal page ids
with equal payloads: one of them by a hash of the url; of rows that repeat as a whole, any one. Null
payloads count as empty and null urls as "". Rows with a null page id are written and read as any.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

SEGMENT_BYTES = 1 << 20
BLOCK_ROWS = 2000
MOST_BLOCKS = 100_000
CAPTURES = "key string, segment long, offset long, length long"


def surt(url: Column) -> Column:
    """Reversed-host key: host labels from the top down, lower-cased, then path and query."""
    clean = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(clean, r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(clean, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host == "", clean).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


# -- records --------------------------------------------------------------------------


def record(page_id, url: str, payload: bytes | None, digest: str, size: int, refers_to=None) -> bytes:
    """One gzip member. The payload of a revisit is not stored."""
    kind = "response" if payload is not None else "revisit"
    body = payload or b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{json.dumps(page_id)}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {json.dumps(url)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{json.dumps(refers_to)}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """Headers by name, and ``payload``; a payload's digest is checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    out: dict = dict(x.split(": ", 1) for x in lines[1:])
    n = int(out["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("record of another length")
    out["payload"] = rest[:n]
    out["url"] = json.loads(f'"{out["WARC-Target-URI"]}"')
    out["page_id"] = json.loads(out["WARC-Record-ID"][10:-1])
    out["refers_to"] = json.loads(out["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in out else None
    if out["WARC-Type"] == "response" and hashlib.sha1(out["payload"]).hexdigest() != out["WARC-Payload-Digest"][5:]:
        raise ValueError("payload and digest differ")
    return out


# -- writing --------------------------------------------------------------------------


def decide(pages: DataFrame, revisit_from: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload or null, sha1, size, refers_to, revisit) of every row."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    long, mark = F.col("size") >= revisit_from, F.xxhash64("url")
    # a short row's group is its own: no key holds more rows than payloads repeat
    rows = rows.withColumns({"sha1": F.sha1("payload"), "size": F.length("payload").cast("long")})
    rows = rows.withColumns({"mark": mark, "task": F.spark_partition_id(), "group": F.when(long, F.sha2("payload", 256)).otherwise(F.concat(F.lit("short "), F.xxhash64("url", "page_id", "size").cast("string")))})
    # groups of two and more alone need to be met again; digests and ids are counted, no payload moves
    alike = rows.where(long).groupBy("group", "page_id", "mark").agg(F.count("*").alias("n"))
    chosen = alike.groupBy("group").agg(F.max(F.struct("page_id", "mark", "n")).alias("best"), F.sum("n").alias("n")).where("n > 1").select("group", "best")
    chosen = C.written(chosen, "repeats", in_few=True)
    # repeats grow with the corpus, so that no bound of theirs allows a broadcast
    met = rows.join(chosen.hint("merge"), "group", "left")
    is_best = F.col("page_id").eqNullSafe(F.col("best.page_id")) & (F.col("mark") == F.col("best.mark"))
    met = met.withColumn("revisit", long & F.col("best").isNotNull() & ~is_best)
    if chosen.where("best.n > 1").head(1):  # whole rows repeat: one of them stays a response
        tied = (F.col("best.n") > 1) & ~F.col("revisit")
        tied = F.coalesce(tied, F.lit(False))
        # one of each scanning task's rows, then one of these
        rest = met.where(tied).repartition("group", "task")
        rest = rest.withColumn("k", F.row_number().over(Window.partitionBy("group", "task").orderBy("page_id")))
        rest = rest.withColumn("share", F.when(F.col("k") == 1, -1).otherwise(F.col("task")))
        rest = rest.withColumn("j", F.row_number().over(Window.partitionBy("group", "share").orderBy("task", "k")))
        rest = rest.withColumn("revisit", (F.col("share") >= 0) | (F.col("j") > 1)).select(*met.columns)
        met = met.where(~tied).unionByName(rest)
    return met.select("page_id", "url", F.when(F.col("revisit"), F.lit(None)).otherwise(F.col("payload")).alias("payload"), "sha1", "size", F.when(F.col("revisit"), F.col("best.page_id")).alias("refers_to"))


def write(decided: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Segment table (segment, data) and capture table, both stored."""
    rows = decided.select(surt(F.col("url")).alias("key"), *decided.columns)

    def run(batches):
        from pyspark import TaskContext

        segment, members, captures, size = TaskContext.get().partitionId() << 32, [], [], 0

        def close():
            return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int64()), "data": pa.array([b"".join(members)], pa.binary()), "captures": pa.array([captures], pa.list_(pa.struct([("key", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))})

        for batch in batches:
            for key, page, url, payload, sha1, n, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = record(page, url, payload, sha1, n, refers)
                if members and size + len(m) > segment_bytes:
                    yield close()
                    segment, members, captures, size = segment + 1, [], [], 0
                captures.append({"key": f"{key} {json.dumps(page)}", "offset": size, "length": len(m)})
                members.append(m)
                size += len(m)
        if members:
            yield close()

    stored = C.written(rows.coalesce(C.few(rows)).mapInArrow(run, "segment long, data binary, captures array<struct<key:string,offset:bigint,length:bigint>>"), "warc")
    return stored.select("segment", "data"), stored.select("segment", F.explode("captures").alias("c")).select("c.key", "segment", "c.offset", "c.length")


def index(captures: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The index's blocks: (id, first, last, rows, block). Sorted by key over all partitions; a block
    is compressed lines of one capture each."""
    block_rows = block_rows or max(BLOCK_ROWS, -(-captures.count() // MOST_BLOCKS))

    def run(batches):
        from pyspark import TaskContext

        number, lines = TaskContext.get().partitionId() << 32, []

        def close():
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            return pa.RecordBatch.from_pydict({"id": pa.array([number], pa.int64()), "first": [lines[0][0]], "last": [lines[-1][0]], "rows": pa.array([len(lines)], pa.int64()), "block": [packed]})

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(x)
                if len(lines) >= block_rows:
                    yield close()
                    number, lines = number + 1, []
        if lines:
            yield close()

    n = min(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), C.few(captures))
    ordered = captures.select("key", "segment", "offset", "length").repartitionByRange(n, "key", "segment", "offset").sortWithinPartitions("key", "segment", "offset")
    return C.written(ordered.mapInArrow(run, "id long, first string, last string, rows long, block binary"), "cdx")


def captures_of(block: bytes) -> list[tuple[str, int, int, int]]:
    return [tuple(json.loads(x)) for x in zlib.decompress(block).decode().split("\n")]


class Directory:
    """The sparse directory: first and last key and number of each block, in key order. At most
    ``MOST_BLOCKS`` entries and one a partition."""

    def __init__(self, blocks: DataFrame):
        self.rows = sorted((r["first"], r["last"], r["id"]) for r in blocks.select("first", "last", "id").collect())
        self.first, self.last, self.id = ([r[i] for r in self.rows] for i in range(3))

    def blocks_of(self, prefix: str, whole: bool = False) -> list[int]:
        """The blocks that can hold keys with this prefix, or with ``whole`` this key alone."""
        lo = bisect.bisect_left(self.last, prefix)
        hi = bisect.bisect_right(self.first, prefix if whole else prefix + "\U0010ffff")
        return self.id[lo:hi]

    def lookup(self, blocks: DataFrame, prefix: str) -> list[tuple[str, int, int, int]]:
        """The captures with this prefix, from the blocks that can hold them."""
        ids = self.blocks_of(prefix)
        found = []
        for r in blocks.where(F.col("id").isin(ids)).select("block").toLocalIterator() if ids else ():
            found += within(captures_of(r["block"]), prefix)
        return sorted(found)


def within(rows: list[tuple[str, int, int, int]], prefix: str, whole: bool = False) -> list[tuple[str, int, int, int]]:
    """The captures of an opened block with this prefix (or key), by bisection."""
    at = end = bisect.bisect_left(rows, (prefix,))
    while end < len(rows) and (rows[end][0] == prefix if whole else rows[end][0].startswith(prefix)):
        end += 1
    return rows[at:end]


def capture_key(page_id: str, url: str) -> Column:
    """The index's key of a page."""
    return F.concat(surt(F.coalesce(F.col(url), F.lit(""))), F.lit(" "), F.coalesce(F.col(page_id).cast("long").cast("string"), F.lit("null")))


def locate(keys: DataFrame, blocks: DataFrame) -> DataFrame:
    """The captures of every key in ``keys`` (column key), by directory, block and bisection; a key that
    the index lacks has none."""
    held = blocks.sparkSession.sparkContext.broadcast(Directory(blocks))

    def bisected():
        def step(batch: pa.RecordBatch):
            met = [(i, k) for k in batch.column(0).to_pylist() for i in held.value.blocks_of(k, whole=True)]
            return {"id": pa.array([i for i, _ in met], pa.int64()), "key": pa.array([k for _, k in met], pa.string())}

        return step

    # a block has a bounded number of captures, so its list of different keys is one
    wanted = C.map_batches(keys.select("key").where("key is not null").distinct(), bisected, "id long, key string").groupBy("id").agg(F.collect_list("key").alias("keys"))

    def search():
        def step(batch: pa.RecordBatch):
            for block, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = captures_of(block)
                found = [x for k in wanted for x in within(rows, k, whole=True)]
                yield {c: pa.array([x[i] for x in found], t) for i, (c, t) in enumerate((("key", pa.string()), ("segment", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())))}

        return step

    return C.map_batches(blocks.join(wanted.hint("merge"), "id").select("block", "keys"), search, CAPTURES, rows=16)


def fetch(segments: DataFrame, captures: list[tuple[str, int, int, int]]) -> list[dict]:
    """The records at these captures (as many as the caller holds), each by the range read of its segment."""
    if not captures:
        return []
    places = segments.sparkSession.createDataFrame(captures, CAPTURES)
    rows = segments.join(F.broadcast(places), "segment").select("key", "segment", "offset", F.expr("substring(data, cast(offset + 1 as int), cast(length as int))").alias("m")).collect()
    at = {(r["key"], r["segment"], r["offset"]): bytes(r["m"]) for r in rows}
    return [parse(at[c[:3]]) | {"key": c[0]} for c in captures]


def read(segments: DataFrame, places: DataFrame) -> DataFrame:
    """What the records at ``places`` (CAPTURES) tell, each read by its range."""
    # a segment has a bounded number of captures, so its list is one
    places = places.groupBy("segment").agg(F.collect_list(F.struct("key", "offset", "length")).alias("captures"))

    def make():
        def step(batch: pa.RecordBatch):
            for data, captures in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for c in captures:
                    r = parse(data[c["offset"] : c["offset"] + c["length"]])
                    size = int(r["X-Payload-Length"])
                    if r["WARC-Type"] == "response" and size != len(r["payload"]):
                        raise ValueError("payload of another length")
                    rows.append((r["page_id"], size, r["WARC-Payload-Digest"][5:], r["WARC-Type"], r["refers_to"], r["url"], c["key"].rsplit(" ", 1)[0]))
                yield dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "key"), map(list, zip(*rows, strict=True)), strict=True))

        return step

    # captures grow with the corpus, so that no bound of theirs allows a broadcast
    return C.map_batches(segments.join(places.hint("merge"), "segment").select("data", "captures"), make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, key string", rows=16)


def export(segments: DataFrame, folder: str) -> DataFrame:
    """Writes each segment as ``folder``/<segment>.warc.gz, where tasks see that folder as a
    file system (a shared mount); returns (segment, path, bytes)."""

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for segment, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{folder}/{segment:016d}.warc.gz"
                with open(f"{path}.part-{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f.name, path)
                yield pa.RecordBatch.from_pydict({"segment": [segment], "path": [path], "bytes": [len(data)]})

    return segments.select("segment", "data").mapInArrow(run, "segment long, path string, bytes long")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    segments, captures = write(decide(pages))
    keys = pages.select(capture_key("page_id", "url").alias("key"))
    return read(segments, locate(keys, index(captures))).drop("url", "key")
