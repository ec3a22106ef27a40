"""WARC archives: writing with revisit records, reading back along verified record boundaries."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Scratch

MAGIC = b"WARC/1.1\r\n"
#: Bytes of payload that one archive file holds on average at most; a task reads one file.
FILE_BYTES = 8 << 20
#: Classes of equal payloads up to which their table, some 100 bytes a row, is broadcast; beyond, a join shuffles.
BROADCAST_CLASSES = 50_000
#: The digits of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Header of the record's key: a decimal number, or "none" for a null.
_KEY, _REFERS = "urn:page:", "WARC-Refers-To"
_DATE = "1970-01-01T00:00:00Z"

_RECORD = "key bigint, uri string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"


def base32(hexed: Column) -> Column:
    """Base32 of a SHA-1 given in hexadecimal digits: five of these are four of those."""
    digits = []
    for at in range(0, 40, 5):
        value = F.conv(F.substring(hexed, at + 1, 5), 16, 10).cast("int")
        digits += [F.substr(F.lit(BASE32), F.shiftright(value, n).bitwiseAND(31) + 1, F.lit(1)) for n in (15, 10, 5, 0)]
    return F.concat(*digits)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> None:
    """Write one record for each row of ``pages`` into plain archives below ``path``, a folder that all tasks share.

    Of rows whose payloads are equal and have at least ``least`` bytes, those with the largest key are responses
    and the others revisits that name that key and carry no payload; rows that tie in key and payload are all
    responses, and a null key is smaller than any other. A null payload counts as empty and a null address as "".
    Payload hashes are counted with partial sums. The table of shared payloads is broadcast if it is small;
    else a join brings rows and classes together, which the adaptive planner can split where a third of the rows
    share a payload. The text writer appends the two line ends that close a record.
    """
    scratch = Scratch(pages.sparkSession, "warc-classes")
    rows = pages.select(pages[key].cast("bigint").alias("key"), F.coalesce(pages[uri].cast("string"), F.lit("")).alias("uri"), F.coalesce(pages[payload], F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("bigint")).withColumn("same", F.sha2("payload", 256))
    last = rows.groupBy("same").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.save(last, "classes")
    total, found = classes.agg(F.sum("copies"), F.count(F.when(F.col("copies") > 1, 1))).first()
    last = classes.where("copies > 1").select("same", "last")
    last = F.broadcast(last) if found <= BROADCAST_CLASSES else last
    marked = rows.join(last, "same", "left")
    revisit = F.col("last").isNotNull() & (F.col("size") >= least) & ~F.col("key").eqNullSafe(F.col("last"))
    name = F.concat(F.lit(f"<{_KEY}"), F.coalesce(F.col("key").cast("string"), F.lit("none")), F.lit(">"))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name),
        line("WARC-Date", F.lit(_DATE)),
        line("WARC-Target-URI", F.regexp_replace("uri", "[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(F.col("payload").cast("binary"))))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line(_REFERS, F.concat(F.lit(f"<{_KEY}"), F.col("last").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    payloads = rows.agg(F.sum("size")).first()[0] or 0
    each = max(1, int(FILE_BYTES * (total or 1) // max(1, payloads)))
    records = marked.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", each).text(path)


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, list[dict[str, str] | None]]:
    """Offsets where a record may begin, the offset its header gives for its successor (-1: none), its headers."""
    starts = np.array([m.start() for m in re.finditer(re.escape(MAGIC), data)], np.int64)
    after = np.full(len(starts), -1, np.int64)
    headers: list[dict[str, str] | None] = []
    for i, at in enumerate(starts.tolist()):
        end = data.find(b"\r\n\r\n", at)
        own = None
        if end >= 0:
            fields = (x.partition(b":") for x in data[at + len(MAGIC) : end].split(b"\r\n"))
            own = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in fields}
            size = own.get("content-length", "")
            if size.isascii() and size.isdigit():
                own["payload-at"] = end + 4
                after[i] = end + 4 + int(size) + 4
                if after[i] > len(data) or data[after[i] - 4 : after[i]] != b"\r\n\r\n":
                    after[i] = -1
        headers.append(own)
    return starts, after, headers


def reachable(starts: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which candidates a chain of boundaries from the file's start reaches, by pointer jumping.

    Each candidate points to the candidate at its successor's offset; the file's end is a last, accepting place.
    In every round the reached set grows by what its pointers reach, and the pointers double their distance.
    """
    n = len(starts)
    places = np.concatenate([starts, [size]])
    found = np.searchsorted(places, after)
    found = np.where((after >= 0) & (found <= n), np.minimum(found, n), n + 1)
    jump = np.where((found <= n) & (places[np.minimum(found, n)] == after), found, n + 1)
    jump = np.concatenate([jump, [n, n + 1]])  # the end and nowhere stay where they are
    reached = np.zeros(n + 2, bool)
    reached[0] = n > 0 and starts[0] == 0
    count = -1
    while count != reached.sum():
        count = reached.sum()
        reached[jump[reached]] = True
        jump = jump[jump]
    if n and not reached[n]:
        raise ValueError("the chain of records does not reach the end of the file")
    return reached[:n]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(0)[i].as_py()
            starts, after, headers = candidates(data)
            rows = []
            for k in np.flatnonzero(reachable(starts, after, len(data))).tolist():
                h = headers[k]
                body = data[h["payload-at"] : int(after[k]) - 4]
                digest = h["warc-payload-digest"].partition(":")[2]
                if h["warc-type"] == "response" and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != int(h["x-payload-length"])):
                    raise ValueError(f"record {h['warc-record-id']} does not hold the payload that its header names")
                number = lambda x: None if x == "none" else int(x)
                name = lambda x: number(x.strip("<>").removeprefix(_KEY))
                refers = h.get(_REFERS.lower())
                rows.append((name(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], refers and name(refers), body, int(h["x-payload-length"]), digest))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "uri", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``: (key, uri, record_type, refers_to, payload, payload_bytes, payload_digest).

    Each task takes whole archives, which the writer bounds in size. It finds every place that looks like a
    record's beginning, works out where the next record would begin, and keeps the places that the chain from
    the file's start reaches, so a payload that holds records of its own does not mislead it. ``payload_bytes``
    and the base32 SHA-1 are those of the full payload, of revisits too. A chain that breaks off raises an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").where(F.octet_length("content") > 0)
    return files.mapInArrow(_read, _RECORD)
