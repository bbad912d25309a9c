r"""WARC archives: a native writer, and a reader that trusts only what the chain of records reaches.

Writing: one record per page, by the text writer with the record trailer as line separator.  Of equal payloads the page
with the largest id is the ``response`` with the payload; the others are ``revisit`` records that refer to it and carry
only headers.  The HTTP header inside a record gives the payload's length, so a revisit states it too.

Reading by boundary-chain verification: an archive is split anywhere; tasks cut it at every occurrence of the version
line (also inside payloads) and emit, for each, where the record that may start there would end.  Prefix sums of the
parts' lengths give file offsets.  Pointer jumping from offset 0 of each file, doubling its stride each round, retains
the candidates that the chain reaches, so a version line or a whole record inside a payload is rejected.  Payloads that
hold such lines are put together again from their parts.

Defined results: a null or empty html is an empty payload (a group like any other); a null page_id is the smallest and is
written as an empty id; of repeated rows with the largest id one is the response; control characters and blanks of a url
are percent-coded, null is empty; an empty table gives no rows.  Archives of others may be compressed (``.warc.gz``, read
whole) and hold records of any type; the chain of a file ends at a record whose header is malformed, and one that the file
cuts short has no payload length or digest.  Extra columns are ignored.  The payload a task holds is
one page; the window that assigns parts to records with inner version lines runs per archive file.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.llm.common import materialise, scratch_path, spread_join, text_of

VERSION = "WARC/1.0\r\n"
DATE = "2024-01-01T00:00:00Z"
TRAILER = "\r\n\r\n"
#: A length of more digits lies beyond any file; sums of lengths of so many fit in 64 bits.
LENGTH_DIGITS = 17
#: Records of these types hold an HTTP message, whose body is the payload; the payload of others is their whole block.
HTTP_TYPES = ("response", "request", "revisit")
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a 40-digit hex string: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _decided(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers: ``refers`` is the response's id (in a struct) for revisits."""
    rows = pages.select("page_id", text_of("url").alias("url"), text_of("html").alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    ids = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1", "n_bytes", "page_id").agg(F.count("*").alias("times"))
    groups = ids.groupBy("sha1", "n_bytes").agg(F.max(F.struct("page_id", "times")).alias("top"), F.sum("times").alias("total"))
    groups = materialise(groups.where("total > 1"), "warc-groups")
    sizes = groups.select("sha1", "n_bytes", F.col("total").alias("n"))
    out = spread_join(rows, groups.drop("total"), ["sha1", "n_bytes"], by="page_id", counts=sizes, how="left")
    is_top = F.col("page_id").eqNullSafe(F.col("top.page_id"))
    out = out.withColumn("again", F.col("top").isNotNull() & ~is_top)
    if not groups.where("top.times > 1").isEmpty():
        tied = F.col("top").isNotNull() & is_top & (F.col("top.times") > 1)
        nth = F.row_number().over(Window.partitionBy("sha1", "n_bytes").orderBy("url"))
        out = out.where(~F.coalesce(tied, F.lit(False))).unionByName(out.where(tied).withColumn("nth", nth).withColumn("again", F.col("nth") > 1).drop("nth"))
    refers = F.when(F.col("again"), F.struct(F.col("top.page_id").alias("page_id")))
    return out.select("page_id", "url", "payload", "n_bytes", base32_of_hex(F.col("sha1")).alias("digest"), refers.alias("refers"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One column ``value``: the record of each page without the trailer."""
    rows = _decided(pages, min_bytes)
    crlf = F.lit("\r\n")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers").isNotNull()
    length = F.char_length(http) + F.when(again, F.lit(0)).otherwise(F.col("n_bytes"))
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers.page_id")), crlf
    )
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    return rows.select(
        F.concat(
            F.lit(VERSION + "WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), crlf,
            F.lit("WARC-Record-ID: "), urn(F.col("page_id")), crlf,
            F.lit(f"WARC-Date: {DATE}\r\nWARC-Target-URI: "), uri, crlf,
            F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), crlf,
            F.when(again, revisit).otherwise(F.lit("")),
            F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
            http, F.when(again, F.lit("")).otherwise(F.col("payload")),
        ).alias("value")
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the pages as uncompressed WARC files, one per task."""
    records(pages, min_bytes).write.option("lineSep", TRAILER).option("compression", "none").text(path)


PARSED = "advance long, complete boolean, record_type string, record_id string, refers string, uri string, n_bytes long, digest string, stated string"
_NAMES = [x.split()[0] for x in PARSED.split(", ")]


def _fields(head: bytes) -> dict[bytes, bytes]:
    """The header fields of a block of lines, names as they stand; of repeated ones the last."""
    return dict(x.split(b": ", 1) for x in head.split(b"\r\n") if b": " in x)


def _number(stated: bytes | None) -> int | None:
    """A stated length, or None if it isn't one that a file offset can hold."""
    return int(stated) if stated is not None and stated.isdigit() and len(stated) <= LENGTH_DIGITS else None


def parse_record(part: bytes) -> dict | None:
    """What the record that starts with this part (after its version line) states and holds; None if it is no record.

    ``advance`` is the distance from the part's start to the next record; ``complete`` whether the part holds all of it.
    Length and digest of the payload are computed if it is complete, and taken from the headers for a revisit.  A part may
    be any bytes that follow a version line inside a payload, so nothing in it can make this raise: a length that is no
    number of at most ``LENGTH_DIGITS`` digits makes the part no record, and a payload length that is none stays null.
    """
    head, sep, _ = part.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = _number(fields.get(b"Content-Length"))
    if not sep or length is None:
        return None
    text = lambda k: fields.get(k, b"").decode("utf-8", "replace")
    start, end = len(head) + 4, len(head) + 4 + length
    out = {
        "advance": end + 4, "complete": len(part) == end + 4, "record_type": text(b"WARC-Type"),
        "record_id": text(b"WARC-Record-ID").removeprefix("<urn:page:").removesuffix(">"),
        "refers": text(b"WARC-Refers-To").removeprefix("<urn:page:").removesuffix(">"), "uri": text(b"WARC-Target-URI"),
        "n_bytes": None, "digest": None, "stated": text(b"WARC-Payload-Digest").removeprefix("sha1:"),
    }
    if out["complete"]:
        http, _, payload = part[start:end].partition(b"\r\n\r\n")
        if out["record_type"] not in HTTP_TYPES:
            payload = part[start:end]
        if out["record_type"] == "revisit":
            out |= {"n_bytes": _number(_fields(http).get(b"Content-Length")), "digest": out["stated"]}
        else:
            out |= {"n_bytes": len(payload), "digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
    return out


def _parts(spark: SparkSession, paths: list[str], keep: bool) -> DataFrame:
    """file, block, nth, start (within the block's parts), n, and the parsed fields (or, with ``keep``, the part) of every
    part between version lines."""
    raw = spark.read.option("lineSep", VERSION).text(paths)
    raw = raw.select(F.col("value").cast("binary").alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    own = "part binary" if keep else f"n long, {PARSED}"
    schema = f"file string, block long, nth int, start long, {own}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nth, start = None, 0, 0
        for batch in batches:
            rows = []
            for part, file, block in zip(batch["part"], batch["file"].to_pylist(), batch["block"].to_pylist(), strict=True):
                if (file, block) != at:
                    at, nth, start = (file, block), 0, 0
                part = part.as_buffer().to_pybytes() if part.is_valid else b""
                row = {"file": file, "block": block, "nth": nth, "start": start}
                rows.append(row | ({"part": part} if keep else {"n": len(part)} | (parse_record(part) or {})))
                nth, start = nth + 1, start + len(part) + len(VERSION)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(k, kinds[v]) for k, v in (x.split() for x in schema.split(", "))])
    return raw.mapInArrow(cut, schema)


def reachable(links: DataFrame) -> DataFrame:
    """file, at: the offsets on the chain from 0, by pointer jumping over (file, at, next).

    After round k the set holds the first 2^k records of each chain and the pointers span 2^k records.  The joins are by
    sorting in every round: links as a whole are never broadcast, however few a round has.
    """
    most = links.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    found = links.where("at = 0").select("file", "at")
    rounds = max(0, most - 1).bit_length()
    for k in range(rounds):
        jumped = found.hint("merge").join(links, ["file", "at"]).select("file", F.col("next").alias("at"))
        found = materialise(found.unionByName(jumped), "warc-found")
        if k == rounds - 1:
            break
        ahead = links.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        links = materialise(links.hint("merge").join(ahead, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "warc-links")
    return found


def _bases(parts: DataFrame) -> DataFrame:
    """file, block, base: where the first part of each block starts in its file."""
    blocks = parts.groupBy("file", "block").agg(F.sum(F.col("n") + len(VERSION)).alias("size"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("file", "block", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_type, record_id, refers, uri, n_bytes, digest, stated of every record on the chains of the archives."""
    parts = materialise(_parts(spark, [path], keep=False), "warc-parts")
    parts = parts.join(_bases(parts), ["file", "block"]).withColumn("start", F.col("base") + F.col("start"))
    parts = parts.withColumn("at", F.col("start") - len(VERSION)).withColumn("next", F.col("start") + F.col("advance"))
    parts = materialise(parts.drop("base", "advance"), "warc-placed")

    found = reachable(parts.where("at >= 0 and next is not null").select("file", "at", "next"))
    kept = parts.join(found, ["file", "at"], "left_semi")
    names = [x for x in _NAMES if x not in ("advance", "complete")]
    whole = kept.where("complete").select(*names)
    broken = materialise(kept.where("not complete").select("file").distinct(), "warc-broken")
    return whole if broken.isEmpty() else whole.unionByName(_stitched(spark, parts, found, broken).select(*names))


def _stitched(spark: SparkSession, parts: DataFrame, found: DataFrame, broken_files: DataFrame) -> DataFrame:
    """The records whose payload holds version lines, from all their parts.

    Their files are read again, by a list of names that is part of the scan's own list of files.  Reading fewer files may
    split them elsewhere, so parts are matched by their place in the file.
    """
    files = [x[0] for x in broken_files.collect()]
    marks = parts.join(broken_files, "file", "left_semi").join(found.withColumn("own", F.col("at")), ["file", "at"], "left")
    owner = F.last("own", ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    marks = marks.withColumn("owner", owner)
    broken = marks.where("own is not null and not complete").select("file", "owner")
    needed = marks.join(broken, ["file", "owner"], "left_semi").select("file", "owner", "start")
    bases = materialise(_bases(_parts(spark, files, keep=False)), "warc-bases")
    pieces = _parts(spark, files, keep=True).join(bases, ["file", "block"]).withColumn("start", F.col("base") + F.col("start"))
    pieces = pieces.join(needed, ["file", "start"])

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        joined = VERSION.encode().join(bytes(x) for x in rows["part"])
        first = parse_record(joined)
        return pd.DataFrame([first | parse_record(joined[: first["advance"]])], columns=_NAMES)

    return pieces.groupBy("file", "owner").applyInPandas(put_together, PARSED)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: write all ``pages``, read them back from the archives."""
    path = scratch_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return read_archives(spark, path).select(
        number("record_id").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", number("refers")).alias("refers_to"),
        (F.col("digest") == F.col("stated")).alias("digest_agrees"),
    )


#: SHA-1 in base32 is computed from its hex digits, four for every five.
OP3_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), coded AS (
  SELECT page_id, payload_bytes, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, 1 + 5 * g, 5) AS BIGINT) >> (15 - 5 * j)) & 31) AS BIGINT), 1), '' ORDER BY g, j) AS payload_digest
  FROM (SELECT page_id, payload_bytes, hex, unnest(range(8)) AS g FROM p), (SELECT unnest(range(4)) AS j)
  GROUP BY page_id, payload_bytes
), tops AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM coded)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to,
  true AS digest_agrees
FROM tops
"""
