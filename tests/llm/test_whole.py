"""The operators against brute force on whole tables, and at their edges."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from augury.llm import decontam, html_text, licenses, lines, mixing, near_dups, toxicity, urls, warc
from augury.llm.common import table

DIR = "/root/testdata/sf0.01"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def shingles(text, k):
    w = words(text)
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def groups(sets, percent):
    """Least id of each component, by all pairs that share a shingle."""
    holders, root = defaultdict(list), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sorted(sets.items()):
        both = Counter(e for g in s for e in holders[g])
        for e, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(d)
    return {d: find(d) for d in sets}


def check_groups(docs, k, percent):
    sets = {r.doc_id: shingles(r.text, k) for r in docs.select("doc_id", "text").collect()}
    want = groups(sets, percent)
    got = {r.doc_id: r for r in near_dups.near_duplicates(docs, k, percent).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_whole_table(spark, k, percent):
    check_groups(table(spark, DIR, "documents"), k, percent)


def test_near_duplicates_crowded_bucket(spark, monkeypatch):
    """Many texts with one passage and no link, some with near copies: buckets are tiled and divided, no link is lost."""
    monkeypatch.setattr(near_dups, "CROWD", 8)
    monkeypatch.setattr(near_dups, "TILE", 4)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(90))
    rows = []
    for i in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((2 * i, passage + " " + " ".join(own)))
        own[-2:] = ["x", f"y{i}"]
        rows.append((2 * i + 1, passage + " " + " ".join(own)))
    check_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)


def test_near_duplicates_crowds_lose_no_pair(spark, monkeypatch):
    """Texts with one passage in common, all buckets crowded: links whose ends share a single band are found."""
    monkeypatch.setattr(near_dups, "CROWD", 0)
    monkeypatch.setattr(near_dups, "TILE", 16)
    rng = random.Random(7)
    passage, texts = [f"p{i}" for i in range(82)], []
    for i in range(400):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(26, 42))]
        pair = [" ".join(passage + own), " ".join(passage[rng.randrange(4) :] + own[: rng.randrange(12, 26)] + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(16))])]
        keys = near_dups.bands(near_dups.registers(near_dups.shingle_sets(pa.array(pair), 3)))
        if (keys[0] == keys[1]).sum() == 1 or i < 30:
            texts += pair
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_groups(docs, 3, 70)


def test_prefixes_of_pairs_at_the_bar_meet():
    """In a bad order too (few cells filled, many ties), sets at the bar share a prefix shingle at places that the size filter lets through."""
    import numpy as np
    rng = np.random.default_rng(5)
    met = 0
    for trial in range(3000):
        percent = int(rng.choice([50, 60, 80, 85, 100]))
        pool = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        size = rng.integers(1, 60)
        s = np.sort(rng.choice(pool, size, replace=False))
        t = np.unique(np.concatenate([s[rng.random(size) < rng.choice([0.8, 0.95, 1])], rng.choice(pool, rng.integers(0, 6))]))
        if not near_dups._alike(s, t, percent):
            continue
        counts = rng.integers(2, 5, near_dups.CELLS)
        (a, i, short_a), (b, j, short_b) = (near_dups.prefix(x, counts, percent) for x in (s, t))
        both, x, y = np.intersect1d(a, b, return_indices=True)
        ok = np.minimum(len(s) - i[x], len(t) - j[y]) * (100 + percent) >= percent * (len(s) + len(t))
        ok &= short_a[x] if len(s) < len(t) else short_b[y] if len(t) < len(s) else short_a[x] & short_b[y]
        assert ok.any()
        met += 1
    assert met > 500


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i % 7919}-{i // 7919}" for i in range(400_000))
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "q r s t u v w x"), (3, "A B C D E F G H"), (4, None), (5, ""), (6, " \n "), (None, "a b c d e f g h"), (7, long), (8, long + " end"), (9, "one"), (9, "one")]
    docs = spark.createDataFrame([(d, t, "z", 1, 2) for d, t in rows], "doc_id long, text string, node string, comp int, sid int")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dups.near_duplicates(docs, 3, 85).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (None, None, True), (7, 7, True), (8, 7, False), (9, 9, True)}


def test_estimate_is_corrected():
    import numpy as np
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        x = np.unique(rng.integers(0, 2**63, 1300, dtype=np.uint64) * np.uint64(2))
        a, b = x[:1150], x[150:]
        r = near_dups.registers([a, b])
        true = len(np.intersect1d(a, b)) / len(x)
        errors.append(near_dups.estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0] - true)
    assert abs(sum(errors) / len(errors)) < 0.015


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_decontamination_whole_table(spark, scale):
    at = f"/root/testdata/{scale}"
    items = {r.item_id: shingles(r.text, 5) for r in table(spark, at, "benchmark").collect()}
    holders = defaultdict(list)
    for i, s in items.items():
        for g in s:
            holders[g].append(i)
    widths = {len(g) for g in holders}
    want = {}
    for r in table(spark, at, "documents").select("doc_id", "text").collect():
        w = words(r.text)
        own = {tuple(w[i : i + k]) for k in widths for i in range(len(w) - k + 1)}
        for i, n in Counter(i for g in own for i in holders.get(g, ())).items():
            if 100 * n >= 80 * len(items[i]):
                want[r.doc_id, i] = n / len(items[i])
    got = decontam.matches(table(spark, at, "documents"), table(spark, at, "benchmark")).collect()
    assert {(r.doc_id, r.item_id): r.containment for r in got} == want and want


def test_many_items_fill_no_filter(spark):
    """The filters grow with the items, so that texts without any item pass no keys on."""
    items = spark.range(3000).select(F.col("id").alias("item_id"), F.expr("array_join(transform(sequence(0, 39), j -> concat('i', id, 'w', j)), ' ')").alias("text"))
    docs = spark.createDataFrame([(1, " ".join(f"o{i}" for i in range(5000))), (2, "x " * 30 + " ".join(f"i77w{j}" for j in range(40)))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.matches(docs, items).collect()] == [(2, 77)]


def test_license_base_columns_whole_table(spark):
    docs = table(spark, DIR, "documents")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    pattern = re.compile(licenses.WORDS)
    for r in docs.collect():
        w, at, labels = pattern.findall((r.text or "").translate(SMALL)), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


def test_license_letters_and_nulls(spark):
    rows = [(1, "ALL Rights\u00a0x all rights reserved"), (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction"),
            (3, "this wor\u212a is licensed under the GNU General Public License"), (None, "cc by"), (None, "cc by"), (None, "CC-BY and all rights reserved"), (4, ""), (5, None)]
    out = licenses.scan(spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, key string")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and got[1].first_word == 2 and got[2].labels == "mit" and got[3].base_labels == "gpl" and got[5].score == 0
    assert sorted(r.n_base for r in out if r.doc_id is None) == [1, 1, 2]


def bisected(sizes, good):
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(mid) else (lo, mid)
    return lo


def test_mixing_exponent_against_bisection(spark):
    sizes = {"a": 900, "b": 60, "c": 30, "d": 10}
    rows = [(i, s, "w " * 10) for s, n in sizes.items() for i in range(n // 10)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    stats = docs.groupBy(F.col("source").alias("_src")).agg(F.sum(mixing.tokens()).alias("size"), F.count("*").alias("rows"))
    share = {s: n / 1000 for s, n in sizes.items()}

    def spread(a):
        v = [x**a for x in share.values()]
        return -sum(x / sum(v) * math.log(x / sum(v)) for x in v) / math.log(len(v))

    def repetition(a):
        return max(x ** (a - 1) for x in share.values()) / min(x ** (a - 1) for x in share.values())

    for target, a in (({"entropy": 0.8}, bisected(sizes, lambda a: spread(a) >= 0.8)), ({"repeat": 3.0}, bisected(sizes, lambda a: repetition(a) > 3))):
        assert 0.01 < a < 0.99
        want = {s: x**a / sum(y**a for y in share.values()) for s, x in share.items()}
        got = {r._src: r.weight for r in mixing.weights(stats, **target).collect()}
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want)
        out = mixing.mix(docs.withColumn("weight", F.lit("kept?")).withColumn("_key", F.lit(1)), **target, block=4).cache()
        assert out.filter("epoch = 0").count() == len(rows) and {"_key", "weight", "place", "slot"} <= set(out.columns)
        drawn = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        total = sum(drawn.values())
        assert all(abs(drawn[s] / total - want[s]) < 0.02 for s in want)
        # Every epoch deals a source's blocks in an order of its own, without gaps.
        places = out.groupBy("source", "epoch").agg(F.max("place").alias("top"), F.countDistinct("place").alias("n")).collect()
        assert all(r.top >= r.n for r in places)
        orders = out.filter("source = 'd'").select("epoch", "place", "block").distinct().collect()
        assert len({tuple(r.block for r in sorted((x for x in orders if x.epoch == e), key=lambda x: x.place)) for e in {x.epoch for x in orders}}) >= 1


def test_lines_with_clashing_columns_and_hot_site(spark):
    rows = [(i, "hot", f"menu\nown {i}\n") for i in range(60)] + [(100 + i, None, f"menu\nbody {i}") for i in range(4)] + [(200, "hot", None), (201, "cold", "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, text string, bad string, site int")
    got = {r.doc_id: r for r in lines.dedup(docs).collect()}
    assert got[0].text == "own 0\n" and got[100].text == "menu\nbody 0" and got[200].text is None and got[201].text == "" and got[0].bad == "x" and len(got) == len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)], docs.schema)
    assert near_dups.near_duplicates(docs).count() == 0
    assert decontam.matches(docs, items).count() == 0 and decontam.clean(some, items).count() == 1
    assert licenses.scan(docs).count() == 0 and lines.dedup(docs).count() == 0 and mixing.mix(docs).count() == 0
    assert html_text.main_text(pages).count() == 0 and urls.judge(pages, urls.rules_table(spark)).count() == 0
    assert warc.round_trip(pages).count() == 0


def test_url_ties(spark):
    rules = spark.createDataFrame([("a.org", "/x", "block"), ("a.org", "/x", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://A.org/x/1", "h"), (2, None, "h"), (3, "no scheme", "h"), (4, "http://b.a.org/x", "h")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()}
    assert got == {1: ("a.org", "/x/1", "a.org/x", "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("b.a.org", "/x", "a.org/x", "allow")}
