"""MinHash near-duplicates on HyperMinHash registers.

The first eight bits of a shingle's hash choose one of 256 buckets; a bucket's register keeps, of the least remaining hash
value, the count of leading zeros and ten mantissa bits. An empty bucket borrows the register of the first filled one on a
probe path of its own, the same for all documents. Bands of six registers find candidates, the collision-corrected estimate
thins them (five standard deviations below the bar), and exact Jaccard on the full sets of 64-bit shingle hashes
confirms each link. A pair at the bar shares no band with chance 3e-7 at 0.85 and 6e-5 at 0.8.

Equal sets are one node. In each band's bucket all nodes first meet its hub, the node whose buckets are fullest, so that n
copies of one text cost n pairs. Nodes that stay outside the hub's component then meet the others in tiles of bounded size
inside Python workers, which find the rows with likely partners and then, with their sets, emit only true links between
components.

The nodes of a bucket with many such nodes (texts that share a passage) are joined by their full sets instead, whatever bands
they share: all shingles stand in one order, rarest first, and two sets at the bar have in common one of the first shingles of
each (a prefix filter, which loses no pair). The order comes from counts in hashed cells and decides only how much is compared.
Such pairs are thinned ten standard deviations below the bar, a chance of 1e-16, less than that of equal hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binaries, hot_keys, hot_lookup, matrix, mix, salted_join, shingle_sets, slices

BUCKETS, BANDS, ROWS, MANTISSA = 256, 32, 6, 10
#: Rows and shingles of a tile, the number of unlinked nodes from which a bucket's nodes are joined by prefixes, and the cells that
#: count shingles for their order.
TILE, LOAD, CROWD, CELLS = 1024, 4 << 20, 4096, 1 << 18
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.arange(BUCKETS)
#: Probe paths of empty buckets: 64 hashed places, then each bucket in turn.
_PROBES = np.concatenate([
    (mix(np.arange(1, 64 * BUCKETS + 1, dtype=np.uint64) * _GOLD) % np.uint64(BUCKETS)).astype(np.int64).reshape(64, BUCKETS),
    (_SLOT[None, :] + 1 + _SLOT[:, None]) % BUCKETS,
])
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of uint16 registers for each sorted, non-empty set: leading-zero count above, mantissa bits below."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = (flat >> np.uint64(56)).astype(np.int64)
    cell = row * BUCKETS + bucket
    least = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted, so the first value of a bucket is its least
    rest = flat[least] << np.uint64(8)
    zeros = np.clip(64 - np.frexp(np.maximum(rest, 1).astype(np.float64))[1], 0, 63).astype(np.uint64)
    code = (zeros << np.uint64(MANTISSA)) | ((rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA))
    own, filled = np.zeros((len(sets), BUCKETS), np.uint16), np.zeros((len(sets), BUCKETS), bool)
    own.ravel()[cell[least]], filled.ravel()[cell[least]] = code.astype(np.uint16), True
    out, (r, b) = own.copy(), np.nonzero(~filled)
    for path in _PROBES:
        if not len(r):
            break
        ok = filled[r, path[b]]
        out[r[ok], b[ok]] = own[r[ok], path[b[ok]]]
        r, b = r[~ok], b[~ok]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """One row of int64 band keys for each row of registers."""
    parts = regs[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(_SALT, parts.shape[:2]).copy()
    for j in range(ROWS):
        h = mix(h + parts[:, :, j])
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard of sets of ``n`` and ``m`` shingles from rows of registers.

    Unequal least values x share a register when they fall in one cell of width 2^floor(log2 x) / 2^mantissa. For
    exponential least values that has chance nm / (n + m)^2 / (2 ln 2) / 2^mantissa, which is taken off."""
    n, m = n.astype(np.float64), m.astype(np.float64)
    chance = n * m / (n + m) ** 2 / (2 * np.log(2)) / 2**MANTISSA
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _bar(percent: int, deviations: int = 5) -> float:
    p = percent / 100
    return p - deviations * (p * (1 - p) / BUCKETS) ** 0.5


def _marks(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sids, regs = [None] * len(sets), [None] * len(sets)
                for i, r in zip(full, registers([sets[i] for i in full]) if full else ()):
                    sids[i], regs[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).hexdigest(), r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.string()), binaries(regs)],
                    names=["doc_id", "n", "sid", "regs"])
    return run


def _with_bands(batches):
    for batch in batches:
        keys = bands(matrix(batch.column("regs"), BUCKETS))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "bands"])


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), binaries([s.tobytes() for s in sets])],
                    names=["node", "n", "shingles"])
    return run


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _keep_likely(bar: float):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ok = estimate(matrix(part.column("ra"), BUCKETS), matrix(part.column("rb"), BUCKETS), _numbers(part, "na"), _numbers(part, "nb")) >= bar
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])
    return run


def _alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if not len(s) or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    at = np.searchsorted(s, t)
    at[at == len(s)] = 0
    both = int((s[at] == t).sum())
    return 100 * both >= percent * (len(s) + len(t) - both)


def _keep_true(percent: int):
    def run(batches):
        for batch in batches:
            ok = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("sa"), batch.column("sb"))]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])
    return run


def _cells(batches):
    """How many shingles fall in each cell."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for part in slices(batch, "shingles"):
            flat = np.frombuffer(b"".join(x.as_buffer() for x in part.column("shingles")), np.uint64)
            at, n = np.unique(flat % np.uint64(CELLS), return_counts=True)
            counts[at.astype(np.int64)] += n
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["cell", "cnt"])


def prefix(s: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, places, short) of a sorted set that may be the first in common with a set at the bar.

    In the order of ``counts`` by cell and then hash, all of the common shingles stand from the first one on. They are at least
    ``percent`` of the longer set, and 2 * percent / (100 + percent) of the shorter one (``short``: the place allows that too). A
    shingle alone in its cell is in no other set."""
    n, seen = len(s), counts[(s % np.uint64(CELLS)).astype(np.int64)]
    place = np.arange(n * (100 - percent) // 100 + 1)
    first = np.argsort(seen, kind="stable")[: len(place)]
    place = place[: len(first)]
    shared = seen[first] > 1
    first, place = first[shared], place[shared]
    return s[first], place, (100 + percent) * (n - place) >= 2 * percent * n


def _prefixes(percent: int, counts):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "shingles"):
                found = [prefix(np.frombuffer(x.as_buffer(), np.uint64), counts.value, percent) for x in part.column("shingles")]
                row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                keys, places, short = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(places.astype(np.int32)), pa.array(short), *[part.column(c).take(row) for c in ("node", "n", "comp")]],
                    names=["bucket", "place", "short", "node", "n", "comp"])
    return run


_SLIM_ROWS = "tile long, side int, band int, place int, comp long, node long, n long"
_TILE_ROWS = _SLIM_ROWS + ", mask long, regs binary"


def _by_tile(batches, work):
    """``work`` on runs of whole tiles; rows come sorted by tile, and a tile has bounded rows."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        key = _numbers(rows, "tile")
        last = int(np.searchsorted(key, key[-1]))  # the last tile may go on in the next batch
        if last:
            yield work(rows.slice(0, last))
        held = rows.slice(last)
    if held is not None:
        yield work(held)


def _likely_pairs(part: pa.RecordBatch, percent: int) -> np.ndarray:
    """Row numbers (2, pairs) of the likely pairs of different components in each tile; without registers, of the possible ones.

    A pair that shares an earlier band in whose tiles both stand (``mask``) is left to that band. ``place`` is that of the tile's
    shingle in the node's order (0 for a band's tile); what is before the first common one is not common."""
    key, side, band, place, comp, node, n = (_numbers(part, c) for c in ("tile", "side", "band", "place", "comp", "node", "n"))
    slim = "regs" not in part.schema.names
    if not slim:
        mask, regs, bar = _numbers(part, "mask"), matrix(part.column("regs"), BUCKETS), np.where(band == BANDS, _bar(percent, 10), _bar(percent))
    rest = (n - place) * (100 + percent)
    ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
    ends = np.repeat(ends, np.diff(ends, prepend=0))
    found = [np.zeros((2, 0), np.int64)]
    at = np.arange(len(key))
    left = ends - at - 1
    while left.any():  # each row with those after it in its tile, at most 16384 pairs at a time
        take = np.minimum(left, 64)
        live = np.flatnonzero(take)
        for lo in range(0, len(live), 256):
            some = live[lo : lo + 256]
            size = take[some]
            i = np.repeat(some, size)
            j = np.repeat(at[some] + 1 - (np.cumsum(size) - size), size) + np.arange(len(i))
            ok = (comp[i] != comp[j]) & (node[i] != node[j]) & ((side[i] == 0) | (side[i] != side[j]))
            ok &= np.minimum(rest[i], rest[j]) >= percent * (n[i] + n[j])
            i, j = i[ok], j[ok]
            if slim:
                found.append(np.stack([i, j]))
                continue
            ok = estimate(regs[i], regs[j], n[i], n[j]) >= bar[i]
            i, j = i[ok], j[ok]
            same = (regs[i, : BANDS * ROWS] == regs[j, : BANDS * ROWS]).reshape(len(i), BANDS, ROWS).all(axis=2)
            seen = (same << np.arange(BANDS)).sum(axis=1) & mask[i] & mask[j] & ((1 << band[i].astype(np.int64)) - 1)
            found.append(np.stack([i, j])[:, seen == 0])
        at, left = at + take, left - take
    return np.concatenate(found, axis=1)


def _likely_rows(percent: int):
    """The rows that have a likely partner in their tile."""
    def work(part):
        return part.take(pa.array(np.unique(_likely_pairs(part, percent))))

    return lambda batches: _by_tile(batches, work)


def _true_links(percent: int):
    """Links of different components in each tile, by their full sets; what earlier links join is not looked at again."""
    def work(part):
        i, j = _likely_pairs(part, percent)
        comp, node = _numbers(part, "comp"), _numbers(part, "node")
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")]
        root: dict = {}

        def find(x):
            while x in root:
                x = root[x]
            return x

        links = []
        for x, y in zip(i.tolist(), j.tolist()):
            u, v = find(comp[x]), find(comp[y])
            if u != v and _alike(sets[x], sets[y], percent):
                root[max(u, v)] = min(u, v)
                links.append(sorted((node[x], node[y])))
        links = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return lambda batches: _by_tile(batches, work)


def components(links: DataFrame) -> DataFrame:
    """(id, comp): each linked document with the least id it reaches, by alternating star contractions."""
    scratch = Scratch(links.sparkSession)
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = scratch.cut(edges, "cc"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        big = big.unionByName(low.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        old, edges = scratch.paths, None
        scratch.paths = []
        edges = scratch.cut(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "cc")
        scratch.paths, done = old, scratch.paths
        scratch.clear()
        scratch.paths = done
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "id")
        before = now


class _Search:
    """The steps of one search, with the tables that they share."""

    def __init__(self, scratch: Scratch, texts: DataFrame, nodes: DataFrame, k: int, percent: int):
        self.scratch, self.texts, self.nodes, self.k, self.percent = scratch, texts, nodes, k, percent

    def with_both(self, pairs: DataFrame, side: DataFrame, names: dict[str, str], hot: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with the columns of ``side`` (node, ...) for both ends; ``names`` gives each column's stem."""
        for end, other in (("b", "a"), ("a", "b")):
            right = side.select(F.col("node").alias(end), *[F.col(c).alias(stem + end) for c, stem in names.items()])
            pairs = salted_join(pairs, right, end, other, hot.withColumnRenamed("id", end))
        return pairs

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that the registers make likely and the full sets confirm."""
        pairs = self.scratch.cut(pairs, "pairs")
        hot = self.scratch.cut(hot_keys(pairs.select(F.explode(F.array("a", "b")).alias("id")), "id"), "hot")
        p = self.with_both(pairs, self.nodes, {"n": "n", "regs": "r"}, hot)
        pairs = self.scratch.cut(p.mapInArrow(_keep_likely(_bar(self.percent)), "a long, b long"), "likely")
        p = self.with_both(pairs, sets, {"shingles": "s"}, hot)
        return self.scratch.cut(p.mapInArrow(_keep_true(self.percent), "a long, b long").distinct(), "links")

    def crowds(self, members: DataFrame, sets: DataFrame, masks: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame]:
        """(links found in the buckets, nodes of those left to prefixes, masks of bands looked at).

        ``members``: bucket, band, place, node, n, comp, outside (pairs with all of the bucket), one row a node, size of set and
        bucket: a doc_id with different texts has several sets, and each pair needs the size of its own. With ``masks`` they are
        buckets of prefixes, none of which is left."""
        heads = members.groupBy("bucket").agg(
            F.sum(F.col("outside").cast("long")).alias("outs"), F.count("*").alias("size"), F.sum("n").alias("load"),
            F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0)).alias("out_load")).filter("outs > 0 and size > 1")
        total = members.count()
        m = hot_lookup(members, heads.withColumn("cnt", F.col("size")), "bucket", "cnt", total).filter("outs is not null")
        m, crowd, prefixes = self.scratch.cut(m, "crowds"), None, masks is not None
        if not prefixes:
            crowd = m.filter(F.col("outs") > CROWD).select("node", "n").distinct()
            # Sets of one doc_id and size have one mask, so a band counts only where none of them is in a crowded bucket.
            bit = lambda now: F.bit_or(F.when(now, F.expr("shiftleft(1L, band)")).otherwise(0))
            masks = m.groupBy("node", "n").agg(bit(F.col("outs") <= CROWD).bitwiseAND(F.bitwise_not(bit(F.col("outs") > CROWD))).alias("mask"))
            masks = self.scratch.cut(masks.filter("mask <> 0"), "masks")
            m = m.filter(F.col("outs") <= CROWD)
        # Tiles of nodes outside the main component come first; those pair with every tile, the others only with them.
        count = lambda rows, load: F.greatest(F.ceil(rows / TILE), F.ceil(load / LOAD)).cast("int")
        whole = count(F.col("size"), F.col("load")) == 1
        outs = F.when(whole, 1).otherwise(count(F.col("outs"), F.col("out_load")))
        mains = F.when(whole, 0).otherwise(count(F.col("size") - F.col("outs"), F.col("load") - F.col("out_load")))
        m = m.withColumns({"o": outs, "t": outs + mains, "h": F.xxhash64("node")})
        own = F.when(F.col("outside") | (F.col("o") == F.col("t")), F.pmod("h", "o")).otherwise(F.col("o") + F.pmod("h", F.col("t") - F.col("o"))).cast("int")
        m = m.withColumn("own", own)
        m = m.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("own") < F.col("o"), F.col("t") - 1).otherwise(F.col("o") - 1))))
        side = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2)
        m = m.withColumns({"tile": F.xxhash64("bucket", F.least("own", "with"), F.greatest("own", "with")), "side": side})
        m = m.select(*[c.split()[0] for c in _SLIM_ROWS.split(", ")])
        if prefixes:  # most rows have no partner by size and place, so registers come after that
            m = m.repartition("tile").sortWithinPartitions("tile").mapInArrow(_likely_rows(self.percent), _SLIM_ROWS)
            m = self.scratch.cut(m, "possible_rows")
        known = self.nodes.join(masks, ["node", "n"], "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
        m = m.join(known, ["node", "n"]).select(*[c.split()[0] for c in _TILE_ROWS.split(", ")])
        m = m.repartition("tile").sortWithinPartitions("tile").mapInArrow(_likely_rows(self.percent), _TILE_ROWS)
        m = self.scratch.cut(m, "likely_rows").join(sets, ["node", "n"]).repartition("tile").sortWithinPartitions("tile")
        return self.scratch.cut(m.mapInArrow(_true_links(self.percent), "a long, b long").distinct(), "rest"), crowd, masks

    def by_prefixes(self, crowd: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
        """Members of a bucket for each shingle in the prefixes of nodes that ``links`` leave in different components.

        All pairs at the bar share such a bucket, and the shorter of the two (either, if equal) has its shingle as ``short``."""
        comps = components(links).withColumnRenamed("id", "node")
        held = crowd.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(sets, ["node", "n"])
        held = self.scratch.cut(held, "held")
        seen = held.select("shingles").mapInArrow(_cells, "cell int, cnt long").groupBy("cell").agg(F.sum("cnt").alias("cnt")).toArrow()
        counts = np.zeros(CELLS, np.int64)
        counts[seen.column("cell").to_numpy()] = seen.column("cnt").to_numpy()
        counts = self.scratch.spark.sparkContext.broadcast(counts)
        rows = held.mapInArrow(_prefixes(self.percent, counts), "bucket long, place int, short boolean, node long, n long, comp long")
        rows = self.scratch.cut(rows, "prefixes")
        counts.destroy()
        mixed = rows.groupBy("bucket").agg(
            F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.col("short").cast("long")).alias("shorts")
        ).filter("lo < hi and shorts > 0").select("bucket", "size", "shorts")
        rows = self.scratch.cut(hot_lookup(rows, mixed.withColumn("cnt", F.col("size")), "bucket", "cnt", rows.count()).filter("size is not null"), "mixed")
        self.scratch.free()
        main = rows.groupBy("bucket", "comp").agg(F.count("*").alias("own"), F.first("size").alias("cnt"))
        main = main.groupBy("bucket").agg(F.max(F.struct("own", "comp")).alias("x"), F.first("cnt").alias("cnt")).select("bucket", "cnt", F.col("x.own").alias("own"), F.col("x.comp").alias("main"))
        rows = hot_lookup(rows, main, "bucket", "cnt", rows.count())
        # Pairs at the bar have a short end, and one outside the largest component: the fewer of these lead the bucket.
        outside = F.when(F.col("shorts") <= F.col("size") - F.col("own"), F.col("short")).otherwise(F.col("comp") != F.col("main"))
        return self.scratch.cut(rows.select("bucket", F.lit(BANDS).alias("band"), "place", "node", "n", "comp", outside.alias("outside")), "members")

    def links(self) -> DataFrame:
        """Links that join all that the full link graph joins."""
        rows = self.nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
        sizes = self.scratch.cut(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        total = sizes.agg(F.sum("size")).first()[0] or 0
        met = hot_lookup(rows, sizes.withColumn("cnt", F.col("size")), "bucket", "cnt", total).filter("size is not null")
        # A node's buckets come together again, so that their sizes give its weight; a node has at most BANDS a set.
        met = met.groupBy("node", "n").agg(F.collect_set(F.struct("bucket", "band", "size")).alias("at"))
        met = self.scratch.cut(met.withColumn("weight", F.expr("aggregate(at, 0L, (x, y) -> x + y.size)")), "met")
        # Only the nodes that share a bucket are looked at from here on.
        self.nodes = self.scratch.cut(self.nodes.join(met.select("node", "n").hint("merge"), ["node", "n"], "left_semi").select("node", "n", "regs"), "nodes")
        wanted = self.texts.join(met.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi").distinct()
        sets = self.scratch.cut(wanted.mapInArrow(_sets(self.k), "node long, n long, shingles binary"), "sets")
        each = met.select("node", "n", "weight", F.explode("at").alias("x")).select("node", "n", "weight", "x.bucket", "x.band")
        hubs = each.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("least"))).alias("best"), F.count("*").alias("cnt"))
        hubs = self.scratch.cut(hubs.select("bucket", "cnt", (-F.col("best.least")).alias("hub")), "hubs")
        self.scratch.free()
        each = self.scratch.cut(hot_lookup(each.drop("weight"), hubs, "bucket", "cnt", total), "each")
        first = each.filter("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        links = self.confirm(first, sets)
        comps = self.scratch.cut(components(links), "comps").withColumnRenamed("id", "node")
        self.scratch.free()
        hub_comps = each.groupBy("hub").agg(F.count("*").alias("cnt"))
        hub_comps = hub_comps.join(comps.withColumnRenamed("node", "hub"), "hub", "left").select("hub", "cnt", F.coalesce("comp", "hub").alias("main"))
        each = each.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        each = hot_lookup(each, hub_comps, "hub", "cnt", total).withColumn("outside", F.col("comp") != F.col("main"))
        members = self.scratch.cut(each.select("bucket", "band", F.lit(0).alias("place"), "node", "n", "comp", "outside"), "members")
        if members.isEmpty():
            return links
        more, crowd, masks = self.crowds(members, sets)
        links = links.unionByName(more)
        crowd = self.scratch.cut(crowd, "crowd")
        if crowd.isEmpty():
            return links
        return links.unionByName(self.crowds(self.by_prefixes(crowd, sets, links), sets, masks)[0])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null or empty texts have no shingles and stand alone; a null doc_id has no component, takes part in no link and is kept;
    rows with one doc_id are one node, linked by each of their texts. An empty table gives no rows. Other columns are not
    looked at. A very long text is read in pieces, and its set of shingle hashes (8 bytes each) is held whole in one worker."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = scratch.cut(texts.mapInArrow(_marks(k), "doc_id long, n long, sid string, regs binary"), "marks", keep=True)
    total = marks.count()
    classes = marks.filter("sid is not null and doc_id is not null").groupBy("sid").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("cnt"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = scratch.cut(classes.mapInArrow(_with_bands, "sid string, node long, cnt long, n long, regs binary, bands array<long>"), "classes")
    links = _Search(scratch, texts, classes, k, percent).links()
    # Rows of one doc_id with different texts join the nodes of these texts.
    several = marks.filter("sid is not null").groupBy("doc_id").agg(F.min(F.xxhash64("sid")).alias("lo"), F.max(F.xxhash64("sid")).alias("hi")).filter("lo <> hi")
    several = scratch.cut(several.select("doc_id"), "several")
    if not several.isEmpty():
        same = marks.join(several, "doc_id").select("doc_id", "sid").distinct().join(classes.select("sid", "node"), "sid")
        links = links.unionByName(same.groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("bs")).select("a", F.explode("bs").alias("b")).filter("a <> b"))
    comps = scratch.cut(components(links), "comps")
    final = classes.select("sid", "cnt", "node").join(comps.withColumnRenamed("id", "node"), "node", "left").select("sid", "cnt", F.coalesce("comp", "node").alias("comp"), "node")
    final = scratch.cut(final.filter("cnt > 1 or comp <> node").select("sid", "cnt", "comp"), "final", keep=True)
    scratch.clear()
    found = hot_lookup(marks.select("doc_id", F.col("n").alias("n_shingles"), "sid"), final, "sid", "cnt", total)
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return found.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))
