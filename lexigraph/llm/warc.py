"""WARC archives and a Merkle fixity audit of replicas.

``write`` lays texts down as WARC response records in volumes (gzip files), ``read`` parses volumes back to records with
their file, offset, length and digest. ``tree`` hashes records and, level by level, ordered ranges of FANOUT ** level
record ids up to the roots. ``audit`` compares two replicas' roots and goes down only where hashes differ, so what it
reads below the roots follows the damage, not the archive. Ranges are of record ids, not of places in a file: a record
that one replica lacks moves no other one, and replicas may be laid out differently.

Null payloads are empty ones. Rows that repeat a record id share a leaf, which hashes how many records there are and sums
of their digests, so a leaf is summed map-side however many rows it has; the audit then tells by digest how many of them
are changed, missing or added. Rows without a record id are known by their digest: changed ones are missing and added. An
empty archive has no roots and no findings. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable

FANOUT, LEVELS = 16, 4
#: Records and, about, bytes that a volume holds at most; a longer record has a volume of its own.
VOLUME_RECORDS, VOLUME_BYTES = 4096, 64 << 20
#: The record layout of the WARC 1.1 format.
VERSION, LINE, NO_DATE = "WARC/1.1", "\r\n", "1970-01-01T00:00:00Z"
FIELDS = "file string, offset bigint, length bigint, digest string, record_id bigint, url string"


def record(record_id: Column, url: Column, payload: Column) -> Column:
    """One response record as a string, but for the two line ends after it. Line ends in URLs are escaped."""
    plain_url = F.regexp_replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    head = F.concat_ws(
        LINE, F.lit(VERSION), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: <urn:lexigraph:"), F.coalesce(record_id.cast("string"), F.lit("none")), F.lit(">")),
        F.lit(f"WARC-Date: {NO_DATE}"), F.concat(F.lit("WARC-Target-URI: "), plain_url), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(F.encode(payload, "UTF-8")).cast("string")),
    )
    return F.concat(head, F.lit(LINE * 2), payload)


def records(pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """record_id, length, digest, record for every row; length and digest are those of the whole record as it is written."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(record_id).cast("bigint").alias("record_id"), record(F.col(record_id), F.col(url), body).alias("record"))
    return rows.select("record_id", (F.octet_length(F.encode("record", "UTF-8")) + 2 * len(LINE)).cast("bigint").alias("length"), digest(F.col("record")).alias("digest"), "record")


def digest(record: Column) -> Column:
    """SHA-256 of a record with its two line ends."""
    return F.sha2(F.encode(F.concat(record, F.lit(LINE * 2)), "UTF-8"), 256)


def write(rows: DataFrame, path: str, *order: Column | str) -> None:
    """Writes the column record as volumes below ``path``, within a volume in the given order."""
    size = F.octet_length(F.encode("record", "UTF-8"))
    n, held, longest = rows.agg(F.count("*"), F.sum(size.cast("bigint")), F.max(size)).first()
    tasks = max(1, -(-(held or 0) // VOLUME_BYTES))
    each = max(1, min(VOLUME_RECORDS, VOLUME_BYTES // max((held or 0) // max(n, 1), (longest or 1) // 64, 1)))
    laid = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if order else rows
    laid.select("record").write.option("lineSep", LINE * 2).option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


_HEADER = re.compile(rb"WARC/[0-9.]+\r\n((?:[^\r\n]+\r\n)*)\r\n")


def parsed(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) for each whole record of a volume; damage is skipped to the next record."""
    at = 0
    while (m := _HEADER.search(raw, at)) is not None:
        headers = dict(x.split(": ", 1) for x in m[1].decode("utf-8", "replace").split("\r\n") if ": " in x)
        size = headers.get("Content-Length", "")
        end = m.end() + int(size) if size.isdigit() and len(size) < 16 else -1
        if end < 0 or raw[end : end + 4] != b"\r\n\r\n":
            at = m.start() + 5
            continue
        yield m.start(), end + 4 - m.start(), headers, raw[m.end() : end]
        at = end + 4


def unpacked(content: bytes) -> bytes:
    """A volume's bytes as far as its compression is whole."""
    if content[:2] != b"\x1f\x8b":
        return content
    opened = zlib.decompressobj(31)
    out = []
    try:
        for at in range(0, len(content), 1 << 20):
            out.append(opened.decompress(content[at : at + (1 << 20)]))
    except zlib.error:
        pass
    return b"".join(out)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """file, offset, length, digest, record_id, url and, if asked for, payload of every record in the volumes below ``path``."""
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["payload"] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                raw, rows = unpacked(content.as_py()), []
                for offset, length, headers, body in parsed(raw):
                    own = re.fullmatch(r"<urn:lexigraph:(-?[0-9]{1,19})>", headers.get("WARC-Record-ID", ""))
                    rows.append((file.as_py().rpartition("/")[2], offset, length, hashlib.sha256(raw[offset : offset + length]).hexdigest(), int(own[1]) if own else None, headers.get("WARC-Target-URI"), *([body.decode("utf-8", "replace")] if payload else [])))
                    if len(rows) == VOLUME_RECORDS or payload and sum(map(len, rows[-1][-1:])) > 1 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], ARROW if not payload else ARROW.append(pa.field("payload", pa.string())))
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], ARROW if not payload else ARROW.append(pa.field("payload", pa.string())))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, FIELDS + ", payload string" * payload)


ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_id", pa.int64()), ("url", pa.string())])


def leaf() -> Column:
    """A record's place in the tree: its id, or, without one, a negative number from its digest, so such records spread."""
    return F.coalesce(F.col("record_id"), -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 40)))


def leaves(rows: DataFrame) -> DataFrame:
    """(node, hash): one node a record id, over the number of its records, their lengths and sums of their digests' quarters."""
    quarter = lambda k: F.sum(F.conv(F.substring("digest", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)"))
    sums = rows.groupBy(leaf().alias("node")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), *(quarter(k).alias(f"q{k}") for k in range(4)))
    said = F.concat_ws(":", "n", "bytes", *(f"q{k}" for k in range(4)))
    return sums.select("node", F.sha2(F.encode(said, "UTF-8"), 256).alias("hash"))


def above(nodes: DataFrame) -> DataFrame:
    """The parents of one level's nodes: hashes of at most FANOUT children in order, with their places."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    said = F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["node"], c["hash"])), ",")
    return nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("parent")).agg(F.sha2(F.encode(said, "UTF-8"), 256).alias("hash")).select(F.col("parent").alias("node"), "hash")


def tree(rows: DataFrame) -> list[DataFrame]:
    """Each level's nodes (node, hash), record ids first; the last has a root for each FANOUT ** (LEVELS - 1) record ids.

    ``rows`` has record_id, length and digest, as ``records`` and ``read`` give them.
    """
    levels = [durable(leaves(rows), "leaves")]
    for level in range(1, LEVELS):
        levels.append(durable(above(levels[-1]), f"level{level}"))
    return levels


def differing(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """(node) of every leaf in which two trees differ."""
    branch = None
    for level in range(LEVELS - 1, -1, -1):
        a, b = (side[level].select("node", F.col("hash").alias(name)) for side, name in ((first, "ours"), (second, "theirs")))
        if branch is not None:
            own = branch.withColumnRenamed("node", "parent")
            a, b = (x.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(own, "parent", "left_semi").drop("parent") for x in (a, b))
        branch = durable(a.join(b, "node", "full").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("node"), f"branch{level}")
    return branch


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """node, record_id, changed, missing, added (how many of its records), file and offset of the first differing record in
    ``theirs``, for every record id in which the second replica differs. ``theirs`` is as ``read`` gives it."""
    apart = differing(tree(ours), tree(theirs))
    held = lambda rows, name, *more: rows.withColumn("node", leaf()).join(apart, "node", "left_semi").groupBy("node", "digest").agg(F.first("record_id").alias(f"{name}_id"), F.count("*").alias(name), *more)
    both = held(ours, "ours").join(held(theirs, "theirs", F.min(F.struct("file", "offset")).alias("at")), ["node", "digest"], "full").fillna(0, ["ours", "theirs"])
    surplus = F.col("ours") - F.col("theirs")
    by = both.groupBy("node").agg(
        F.max(F.coalesce("ours_id", "theirs_id")).alias("record_id"), F.sum(F.greatest(surplus, F.lit(0))).alias("less"), F.sum(F.greatest(-surplus, F.lit(0))).alias("more"),
        F.min(F.when(surplus < 0, F.col("at"))).alias("at"),
    )
    changed = F.least("less", "more")
    return by.select("node", "record_id", changed.alias("changed"), (F.col("less") - changed).alias("missing"), (F.col("more") - changed).alias("added"), "at.file", "at.offset")
