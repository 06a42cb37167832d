"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items of at most 8 distinct shingles are looked up by exact shingle: a document that holds enough of them holds one of
any (all - needed + 1), so that many are keys, and none is missed. Longer items fall into partitions by their count of
shingles (upper bound u, doubling from 16). A document is cut, per partition, into windows of 2u shingles every u, so that an
item of the partition stands whole in some window. A Bloom filter of all items' shingles, sized from their number, first tells
which shingles of the document may be an item's; windows with too few for any item of the partition are passed over. A
window's set is what is left of its shingles, so its likeness J with an item inside it, of which it holds a part c, is at least
c / (5 - c), and c itself unless other items stand in the same window. Each of 40 minima alone is a band, so (1 - J)^40 are
missed. Spark joins the minima with the items' minima, and each pair found is verified: the document's shingles that passed
the filter hold all that it shares with any item, so containment is exact without reading the text again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binaries, cut, hot_keys, mix, rolling, salted_join, shingles, slices, word_hashes

BANDS, K, PERCENT = 40, 5, 80
#: Items of at most so many distinct shingles are looked up exactly; 0 is their partition.
SHORT = 8
#: Bits of a filter for each key, and the least and greatest size of a filter (2^30 bits are 128 MB). A full filter passes more, never less.
PER_KEY, LEAST_BITS, MOST_BITS = 16, 16, 30
_SEEDS = mix(np.arange(101, 101 + BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _upper(n: int) -> int:
    return max(16, 1 << int(n - 1).bit_length())


def _band_keys(least: np.ndarray, upper: int, width: int) -> np.ndarray:
    """Keys of minima (.., BANDS), distinct by band, partition and shingle width."""
    return mix(least ^ mix(_SEEDS + np.uint64(upper) * np.uint64(1 << 20) + np.uint64(width)))


def _exact_keys(values: np.ndarray, width: int) -> np.ndarray:
    """Keys of shingles themselves, distinct by width."""
    return mix(values ^ mix(_SEEDS[:1] + np.uint64(width)))


def _minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least value of each run of ``values`` under each of the seeds."""
    return np.stack([np.minimum.reduceat(mix(values ^ seed), starts) for seed in _SEEDS], axis=1)


_ITEM = "item_id long, width int, upper int, n int, shingles binary, keys array<long>"


def _item_rows(k: int, percent: int):
    def run(batches):
        for batch in batches:
            rows = []
            h, ends = word_hashes(batch.column("text"))
            for i, words in zip(batch.column("item_id").to_pylist(), np.split(h, ends[:-1]) if len(ends) else []):
                if not len(words):
                    continue
                width = min(k, len(words))
                run_ = rolling(words, width)
                s = _exact_keys(np.unique(run_), width)
                if len(s) <= SHORT:
                    upper, keys = 0, s[: len(s) - -(-percent * len(s) // 100) + 1]
                else:
                    upper = _upper(len(run_))
                    keys = _band_keys(_minima(s, np.zeros(1, np.int64))[0], upper, width)
                rows.append((i, width, upper, len(s), np.sort(s).tobytes(), keys.view(np.int64)))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            names = [c.split()[0] for c in _ITEM.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=names)
    return run


def _unpacked(batches):
    for batch in batches:
        for x in batch.column("shingles"):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64))], names=["key"])


class _Filter:
    """A Bloom filter with two bits a key."""

    def __init__(self, keys: DataFrame, count: int):
        self.bits = min(max(LEAST_BITS, (PER_KEY * count).bit_length()), MOST_BITS)
        bits = self.bits

        def words(batches):
            for batch in batches:
                at = _Filter.places(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

        got = keys.mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.table = np.zeros(1 << (bits - 6), np.uint64)
        self.table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        shift = np.uint64(64 - bits)
        return np.concatenate([keys >> shift, (keys * np.uint64(0x9E3779B97F4A7C15)) >> shift]).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - self.bits)
        ok = np.ones(len(keys), bool)
        for x in (keys >> shift, (keys * np.uint64(0x9E3779B97F4A7C15)) >> shift):
            at = np.flatnonzero(ok)
            x = x[at]
            ok[at] = (self.table[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1
        return ok


def _window_keys(at: np.ndarray, keys: np.ndarray, upper: int, width: int, least: int) -> np.ndarray:
    """Band keys of the windows of 2 * upper shingles, at every upper, that hold at least ``least`` of the given (place, key)."""
    out, step = [np.zeros(0, np.uint64)], at // upper
    for odd in (0, 1):  # windows that start at an even or an odd step; together each step and the next
        window = (step + odd) // 2
        starts = np.flatnonzero(np.diff(window, prepend=-1))
        sizes = np.diff(np.append(starts, len(window)))
        live = np.repeat(sizes >= least, sizes)
        if live.any():
            some = sizes[sizes >= least]
            out.append(_band_keys(_minima(keys[live], np.cumsum(some) - some), upper, width).ravel())
    return np.unique(np.concatenate(out))


def _found(kinds: list[tuple[int, int, int]], gate: _Filter, known: _Filter):
    """(doc_id, hits, keys) of each text with a key that the items may have; hits are its item shingles."""
    widths = sorted({w for w, _, _ in kinds})

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, ends = word_hashes(part.column("text"))
                n = np.diff(ends, prepend=0)
                passed: dict[int, list] = {}
                for width in widths:
                    flat, to = shingles(h, ends, width)
                    values = _exact_keys(flat, width)
                    spots = np.flatnonzero(gate(values))
                    row = np.searchsorted(to, spots, side="right")
                    whole = n[row] >= width  # a shorter text's one run of all words is no shingle of this width
                    spots, row = spots[whole], row[whole]
                    place = spots - (to[row] - (n[row] - width + 1))
                    cuts = np.flatnonzero(np.diff(row, prepend=-1))
                    for r, lo, hi in zip(row[cuts], cuts, np.append(cuts[1:], len(row))):
                        passed.setdefault(int(r), []).append((width, place[lo:hi], values[spots[lo:hi]]))
                rows, hits, keys = [], [], []
                for r, found in sorted(passed.items()):
                    got = []
                    for width, place, values in found:
                        for w, upper, least in kinds:
                            if w == width:
                                got.append(_window_keys(place, values, upper, width, least) if upper else np.unique(values))
                    got = np.concatenate(got)
                    got = got[known(got)]
                    if len(got):
                        rows.append(r)
                        hits.append(np.unique(np.concatenate([v for _, _, v in found])).tobytes())
                        keys.append(got.view(np.int64))
                ids = part.column("doc_id").cast(pa.int64()).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, binaries(hits), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "hits", "keys"])
    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok, part = [], []
            for x, y in zip(batch.column("hits"), batch.column("shingles")):
                hits, item = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int(np.isin(item, hits).sum())
                ok.append(100 * both >= percent * len(item))
                part.append(both / len(item))
            keep = pa.array(ok, pa.bool_())
            cols = [batch.column("doc_id"), batch.column("item_id"), pa.array(part, pa.float64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=["doc_id", "item_id", "containment"])
    return run


def matches(docs: DataFrame, items: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, containment) where a document holds at least ``percent`` of an item's distinct k-word shingles.

    Words are split at ASCII white space and A-Z lower-cased; shingles are compared by 64-bit hashes. Items of fewer than k
    words are one shingle of all their words. Empty or null items and texts match nothing, nor do null ids; repeated rows
    match once, and rows of one doc_id with different texts each by their own text. Without documents or items there are no
    rows. Other columns are not looked at. A very long text is read in pieces; its hashes are held in one worker."""
    scratch = Scratch(docs.sparkSession)
    items = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    known = scratch.cut(items.distinct().mapInArrow(_item_rows(k, percent), _ITEM), "items")
    # One row for each width and power of two of item lengths: the log of the longest item.
    kinds = known.groupBy("width", "upper").agg(F.min("n").alias("n"), F.sum("n").alias("total"), F.sum(F.size("keys")).alias("keys")).collect()
    item_keys = known.select("item_id", F.explode("keys").alias("key"))
    gate = _Filter(known.select("shingles").mapInArrow(_unpacked, "key long"), sum(r["total"] for r in kinds))
    filter_ = _Filter(item_keys.select("key"), sum(r["keys"] for r in kinds))
    kinds = sorted((r["width"], r["upper"], -(-percent * r["n"] // 100)) for r in kinds)
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    found = texts.mapInArrow(_found(kinds, gate, filter_), "doc_id long, hits binary, keys array<long>")
    found = scratch.cut(found.withColumn("row", F.xxhash64("doc_id", "hits")), "found")
    asked = found.select("row", F.explode("keys").alias("key"))
    pairs = salted_join(asked, item_keys, "key", "row", scratch.cut(hot_keys(asked, "key"), "hot")).select("row", "item_id").distinct()
    pairs = scratch.cut(pairs, "pairs")
    full = salted_join(pairs, known.select("item_id", "shingles"), "item_id", "row", scratch.cut(hot_keys(pairs, "item_id"), "hot"))
    full = full.join(found.select("row", "doc_id", "hits"), "row")
    out = full.select("doc_id", "item_id", "hits", "shingles").mapInArrow(_verify(percent), "doc_id long, item_id long, containment double")
    out = scratch.cut(out.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment")), "matches", keep=True)
    scratch.clear()
    return out


def clean(docs: DataFrame, items: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item; rows without a doc_id or text stay."""
    leaks = cut(matches(docs, items, k, percent).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id") == F.col("_leak"), "left_anti")
