"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes; a cut needs more zero bits before the normal chunk size and fewer after it. The
fingerprint is the set of chunk digests with their total lengths, and likeness is the part of a document's bytes whose
chunks stand in the other one (containment), so that inserted text shifts no later chunk."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

LEAST, NORMAL, MOST = 8, 32, 256
_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_HARD, _EASY = np.uint64(0x7F << 57), np.uint64(0x7 << 61)


def _gear(data: bytes) -> np.ndarray:
    """The hash of the last 64 bytes at every position: each doubling joins two neighbouring stretches."""
    h, k = _GEAR[np.frombuffer(data, np.uint8)], 1
    while k < 64:
        h = np.concatenate([h[:k], h[k:] + (h[:-k] << np.uint64(k))]) if len(h) > k else h
        k *= 2
    return h


def cuts(data: bytes) -> list[int]:
    h = _gear(data)
    hard, easy = np.flatnonzero((h & _HARD) == 0) + 1, np.flatnonzero((h & _EASY) == 0) + 1
    out, at, n = [], 0, len(data)
    while n - at > LEAST:
        i = np.searchsorted(hard, at + LEAST)
        if i < len(hard) and hard[i] < at + NORMAL:
            to = int(hard[i])
        else:
            i = np.searchsorted(easy, at + NORMAL)
            to = int(easy[i]) if i < len(easy) else n
        at = min(to, at + MOST, n)
        out.append(at)
    return out if out and out[-1] == n else out + [n] if n else out


def fingerprint(text: str) -> dict[bytes, int]:
    data, at, out = text.encode("utf-8", "replace"), 0, {}
    for to in cuts(data):
        d = hashlib.blake2b(data[at:to], digest_size=6).digest()
        out[d] = out.get(d, 0) + to - at
        at = to
    return out


def _length(n: int) -> bytes:
    """Seven bits a byte, the highest bit set on all but the last."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(fp: dict[bytes, int]) -> str:
    return base64.b64encode(b"".join(d + _length(n) for d, n in sorted(fp.items()))).decode()


def likeness(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    """Part of ``a`` that is in ``b``; two empty fingerprints are alike."""
    total = sum(a.values())
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / total if total else float(not b)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document with its own and its edited text's fingerprint; see the columns below.

    Rows are dealt in ranges of doc_id; the first rows of a range also go to the range before, so each task has the
    next document of its last one. A null doc_id comes before all others, equal ones follow the order of their texts.
    A null text is empty. A lone document is its own next one. An empty table gives no rows; other columns are not looked at.
    A text's bytes and hashes (8 bytes each) are held whole by one worker, however long it is."""
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    bounds = d.select(F.percentile_approx(key, [j / parts for j in range(1, parts)], 10000)).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(int(b)).cast("long") for b in bounds])
        part = F.size(F.filter(edges, lambda b: b < key))
    d = d.withColumn("part", part)
    firsts = [r["part"] for r in d.select("part").distinct().collect()]  # at most `parts` numbers
    firsts.sort()
    before = {p: firsts[j - 1] for j, p in enumerate(firsts)}
    heads = d.groupBy("part").agg(F.min(key).alias("head"))
    d = d.join(F.broadcast(heads.withColumnRenamed("part", "_p")), F.col("part") == F.col("_p")).drop("_p")
    back = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    # A number for each part that Spark's hash deals to a task of its own; the parts' own numbers would meet in some tasks.
    ids = spark.range(40 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("task")).groupBy("task").agg(F.min("id").alias("id")).collect()
    spread = {r["task"]: r["id"] for r in ids}
    tasks = F.array(*[F.lit(spread.get(p, p)).cast("long") for p in range(parts)])
    own = F.struct(F.col("part").alias("at"), F.lit(False).alias("lent"))
    lent = F.struct(back[F.col("part")].alias("at"), F.lit(True).alias("lent"))
    d = d.withColumn("_x", F.explode(F.when(key == F.col("head"), F.array(own, lent)).otherwise(F.array(own))))
    d = d.select("doc_id", "text", "_x.at", "_x.lent").withColumn("task", tasks[F.col("at")]).repartition(parts, "task").sortWithinPartitions("at", "lent", "doc_id", "text")

    def rows(batches):
        def one(cur, nxt):
            (i, t, f), (_, u, g) = cur, nxt
            half = len(t) // 2
            edited = t[: len(t) - half] + u[:half]
            e = fingerprint(edited)
            return i, len(t), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), encode(f), encode(e), likeness(f, e), likeness(f, g)

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last, at, done = None, None, False
        for pdf in batches:
            out = []
            for i, t, p, lent in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["text"], pdf["at"], pdf["lent"]):
                if p != at:
                    last, at, done = None, p, False
                if done:
                    continue
                cur = (i, t, fingerprint(t))
                if last is not None:
                    out.append(one(last, cur))
                last, done = cur, bool(lent)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return d.mapInPandas(rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
