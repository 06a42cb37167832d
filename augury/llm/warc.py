"""WARC files: written by Spark's own writer, read back with boundary-chain verification.

A record's header and payload are one string, and the record ends with the format's two line ends, which is the
writer's line separator; so task commits and retries are Spark's. On reading, every place that looks like a record start is a candidate
with the offset of its successor; pointer jumping from the file's start keeps only the reachable ones, so that payloads holding whole
records cannot pass as such. Files are compressed as .gz and bounded in bytes; a file's chain is followed inside one task."""

from __future__ import annotations

import gzip
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_lookup, new_path, remove

LEAST = 1000
#: Greatest payload, and records a file, of each class of records but the last, whose files hold one: a file is at most 128 MB, or one record.
CLASSES = [(1 << 16, 2000), (1 << 20, 125), (1 << 24, 8)]
MAGIC = b"WARC/1.1\r\n"
_HEAD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")


def plan(pages: DataFrame) -> DataFrame:
    """Adds digest, bytes, and first: the page_id that the record revisits (null for responses)."""
    body = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", F.col("url").alias("uri"), body.alias("payload"))
    p = p.withColumns({"digest": F.sha1(F.encode("payload", "utf-8")), "bytes": F.octet_length("payload").cast("long")})
    same = p.filter(F.col("bytes") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    same = same.filter("n > 1").select(F.col("digest").alias("same"), "first", "n")
    facts = p.withColumn("same", F.when(F.col("bytes") >= LEAST, F.col("digest")))
    out = hot_lookup(facts, same, "same", "n", max(p.count(), 1))
    return out.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("same")


def records(planned: DataFrame):
    """One string column ``value``: the records without their closing line ends."""
    end = "\r\n"
    revisit = F.col("first").isNotNull()
    uri = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\x00-\x20]", "%20")
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1" + end + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(end + "WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">" + end + "WARC-Target-URI: "), uri, F.lit(end + "WARC-Date: 1970-01-01T00:00:00Z"),
        F.lit(end + "WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(end + "X-Payload-Bytes: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(end + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + end + "WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(end + "Content-Type: text/html; charset=utf-8" + end + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(end + end),
    )
    return planned.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Archives below ``path``, one folder a class of payload sizes, so that a file is bounded in bytes and not only in records."""
    planned = plan(pages)
    kind = F.lit(len(CLASSES))
    for i, (most, _) in reversed(list(enumerate(CLASSES))):
        kind = F.when(F.octet_length(F.coalesce("html", F.lit(""))) <= most, i).otherwise(kind)
    present = sorted(r[0] for r in pages.select(kind.alias("kind")).distinct().collect())  # at most four numbers
    for i in present:
        low, (high, count) = CLASSES[i - 1][0] if i else -1, CLASSES[i] if i < len(CLASSES) else (1 << 62, 1)
        out = records(planned.filter((F.col("bytes") > low) & (F.col("bytes") <= high)) if len(present) > 1 else planned)
        out.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", count).option("compression", "gzip").text(f"{path}/{i}")


def chain(data: bytes) -> tuple[list[tuple[int, int, int]], bool]:
    """(start, body, end) of the records reachable from the start, and whether the chain meets the file's end."""
    found = []
    for m in re.finditer(re.escape(MAGIC), data):
        stop = data.find(b"\r\n\r\n", m.end() - 2)
        size = re.search(rb"\r\nContent-Length:[ \t]*(\d+)\r\n", data[m.end() - 2 : stop + 2]) if stop >= 0 else None
        if size and data[stop + 4 + int(size[1]) : stop + 8 + int(size[1])] == b"\r\n\r\n":
            found.append((m.start(), stop + 4, stop + 4 + int(size[1])))
    n = len(found)
    if not n or found[0][0]:
        return [], not data
    at = np.array([f[0] for f in found] + [-1])
    succ = np.array([f[2] + 4 for f in found])
    jump = np.append(np.searchsorted(at[:-1], succ), n)
    bad = (jump[:-1] < n) & (at[np.minimum(jump[:-1], n)] != succ)
    jump[:-1][bad] = n
    reach, last = np.zeros(n + 1, bool), jump.copy()
    reach[0] = True
    for _ in range(max(n, 1).bit_length()):
        reach[jump[reach]] = True
        jump = jump[jump]
    kept = [found[j] for j in np.flatnonzero(reach[:n])]
    return kept, bool(last[n] == n and kept[-1][2] + 4 == len(data))


def _read(batches):
    names = ["page_id", "uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    for pdf in batches:
        for data in pdf["content"]:
            data = gzip.decompress(data)
            kept, whole = chain(data)
            if not whole:
                raise ValueError("a WARC file's records do not reach its end")
            out = []
            for start, body, end in kept:
                h = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEAD.findall(data[start + len(MAGIC) : body])}
                urn = lambda x: None if x is None or not (n := x[10:-1]).lstrip("-").isdigit() else int(n)
                kind, block = h["warc-type"], data[body:end]
                digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-bytes"])
                if kind == "response" and (hashlib.sha1(block).hexdigest() != digest or len(block) != size):
                    raise ValueError("a payload differs from its digest")
                out.append((urn(h["warc-record-id"]), h.get("warc-target-uri"), kind, urn(h.get("warc-refers-to")), digest, size, block if kind == "response" else None))
                if len(out) >= 200:
                    yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read(spark, path: str) -> DataFrame:
    """The records of all files: page_id, uri, record_type, refers_to, payload_digest, payload_bytes, payload (null for revisits)."""
    none = "page_id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):  # no pages, no archives
        return spark.createDataFrame([], none)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInPandas(_read, none)


def round_trip(pages: DataFrame) -> DataFrame:
    """What comes back of ``pages`` written to the shared folder and read again; the archives stay there.

    A null html is an empty payload; a null page_id stays null, and so does its revisits' reference. Repeated rows are records of
    their own. An empty table gives no rows; other columns are not looked at. A page is one record, held whole by one worker."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)


def verified(pages: DataFrame) -> DataFrame:
    """``round_trip`` without the payloads, whose bytes were held against their digests; the archives are deleted."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write(pages, path)
    out = cut(read(spark, path).drop("payload"), "records")
    remove(spark, path)
    return out
