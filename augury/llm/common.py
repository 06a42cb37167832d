"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: Bytes of text that a Python worker turns into arrays at once; a longer text is read in pieces of about so many.
SLICE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or a local one where it is unset and the master is local (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="augury-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage and survives lost executors."""
    return Scratch(df.sparkSession).cut(df, label)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in the shared folder. ``clear`` deletes those that were not kept, once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, label: str = "cut", keep: bool = False) -> DataFrame:
        path = new_path(self.spark, label)
        df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
        self.free()

    def free(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now; it does so when the driver collects their plans."""
        self.spark.sparkContext._jvm.System.gc()


def lower_ascii(text):
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: White space of the near-duplicate contract, as bytes of UTF-8; no byte of a longer character is one of them.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) | np.uint64(1)
_STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE):
    """Runs of rows of a batch with at most ``limit`` bytes in ``column``, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, positions of first bytes); a word also starts at each of ``bounds``."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    first[bounds] = solid[bounds]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    chars, at = data[solid], np.flatnonzero(first[solid])
    sizes = np.diff(np.append(at, len(chars)))
    place = np.arange(len(chars)) - np.repeat(at, sizes)
    weight = _PLACE[place] if sizes.max() <= len(_PLACE) else mix(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    return mix(np.add.reduceat(_BYTE[chars] * weight, at) + sizes.astype(np.uint64)), starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in order, end of each text's words), equal on every machine.

    A-Z is lower-cased and words are split at ASCII white space; nulls have no words. Texts are read in pieces of about
    ``SLICE`` bytes that end at white space, so memory beyond the hashes is bounded but for longer single words."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = ends - ends[0]
    found, starts, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(data):
        hi = min(lo + SLICE, len(data))
        while hi < len(data):
            spaces = np.flatnonzero(_SPACE[data[hi : hi + 4096]])
            hi = min(hi + (int(spaces[0]) if len(spaces) else 4096), len(data))
            if len(spaces):
                break
        inside = bounds[:-1][(bounds[:-1] >= lo) & (bounds[:-1] < hi)]
        h, s = _hashes(data[lo:hi], inside - lo)
        found.append(h)
        starts.append(s + lo)
        lo = hi
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), bounds[1:])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes; none where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64) * _GOLD
    for j in range(k):
        out += h[j : j + n] * _STEP[j]
    return mix(out)


def shingles(h: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends) of all k-word shingles of each text in order; of the whole sequence as one where it is shorter."""
    n = np.diff(ends, prepend=0)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.cumsum(count)
    if not len(to) or not to[-1]:
        return np.zeros(0, np.uint64), to
    full = rolling(h, k)
    if not len(full):
        full = np.zeros(1, np.uint64)
    at = np.arange(to[-1]) + np.repeat((ends - n) - (to - count), count)
    out = full[np.minimum(at, len(full) - 1)]
    for width in range(1, k):
        short = n == width
        if short.any():
            out[(to - count)[short]] = rolling(h, width)[(ends - n)[short]]
    return out, to


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat, ends = shingles(*word_hashes(texts), k)
    return [np.unique(x) for x in np.split(flat, ends[:-1])] if len(ends) else []


def binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix of uint16."""
    flat = np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint16) if len(column) else np.zeros(0, np.uint16)
    return flat.reshape(len(column), width)


def hot_keys(facts: DataFrame, key: str, share: int = 500) -> DataFrame:
    """Values of ``key`` in over one in ``share`` of all facts: fewer than ``share`` rows, whatever the input."""
    total = facts.count()
    return facts.groupBy(key).count().filter(F.col("count") > max(total // share, 20)).select(key)


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, spread: str, hot: DataFrame, parts: int = 64) -> DataFrame:
    """Inner join on ``key`` (long), the facts of hot keys dealt in ``parts`` by ``spread``; ``hot`` is bounded, see hot_keys."""
    mark = F.broadcast(hot.select(F.col(key).alias("_hot")))
    p = facts.join(mark, F.col(key) == F.col("_hot"), "left")
    p = p.withColumn("_s", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))).drop("_hot")
    s = lookup.join(mark, F.col(key) == F.col("_hot"), "left")
    s = s.withColumn("_s", F.explode(F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1))))).drop("_hot")
    return p.join(s, [key, "_s"]).drop("_s")


def hot_lookup(facts: DataFrame, lookup: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``facts`` with ``lookup`` (one row a key, ``count`` facts each) without a hot task.

    Keys with over a thousandth of all facts are fewer than 1000 whatever the input, so they are broadcast; their facts
    get a key of their own in the other join, which deals them evenly."""
    values = [c for c in lookup.columns if c not in (key, count)]
    bar = max(total // 1000, 10)
    hot = lookup.filter(F.col(count) > bar).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    cold = lookup.filter(F.col(count) <= bar).select(F.col(key).alias("_ck"), F.lit(True).alias("_cl"), *[F.col(c).alias(f"_c_{c}") for c in values])
    out = facts.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    # A hash of the row's own values: even, and the same on a retry, unlike a random key.
    own = F.xxhash64(*facts.columns).cast(facts.schema[key].dataType)
    out = out.withColumn("_l", F.col("_hk").isNull() & F.col(key).isNotNull())
    out = out.withColumn("_j", F.when(F.col("_l"), F.col(key)).otherwise(own))
    out = out.join(cold, (F.col("_j") == F.col("_ck")) & (F.col("_l") == F.col("_cl")), "left")
    return out.select(*facts.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in values])
