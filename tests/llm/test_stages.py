"""Each stage of the corpus pipeline, on what the stage before kept, against brute force."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest
from augury.llm import near_dups, toxicity
from augury.llm.common import cut, table
from test_whole import groups, shingles, words

DIR = "/root/testdata/sf0.01"


def boilerplate(rows):
    """(source, line) on at least 5 and over 0.02 of a source's pages, pages with the same lines once."""
    pages = defaultdict(set)
    for r in rows:
        pages[r.source].add(tuple(dict.fromkeys(x.strip(" ") for x in (r.text or "").split("\n") if x.strip(" "))))
    out = set()
    for source, own in pages.items():
        seen = Counter(x for page in own for x in page)
        out |= {(source, x) for x, n in seen.items() if n >= 5 and n > 0.02 * len(own)}
    return out


def test_every_stage(spark):
    docs, stages = table(spark, DIR, "documents"), dict(corpus_pipeline.STAGES)
    kept = {}
    for name in stages:
        before = {r.doc_id: r for r in docs.collect()} if name != "mixing" else None
        if name == "mixing":
            last = {r.doc_id: r for r in docs.collect()}
        docs = cut(stages[name](spark, docs, DIR), name)
        kept[name] = docs.collect()
        after = {r.doc_id: r for r in kept[name]}
        if name == "toxicity":
            model = toxicity.train(table(spark, DIR, "documents"), table(spark, DIR, "labels"))
            rejected = {r.doc_id for r in toxicity.score(table(spark, DIR, "documents"), model).collect() if r.predicted}
            assert set(after) == set(before) - rejected and rejected
        elif name == "line_dedup":
            bad = boilerplate(before.values())
            assert set(after) == set(before) and bad
            for d, r in before.items():
                want = r.text and "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad)
                assert after[d].text == want and after[d].n_chars == (None if want is None else len(want))
        elif name == "near_duplicates":
            least = groups({d: shingles(r.text, 5) for d, r in before.items()}, 80)
            assert set(after) == {d for d, c in least.items() if d == c} != set(before)
        elif name == "decontamination":
            items = [shingles(r.text, 5) for r in table(spark, DIR, "benchmark").collect()]

            def leaks(text):
                w = words(text)
                return any(s and 100 * sum(g in own for g in s) >= 80 * len(s) for s in items for own in [{tuple(w[i : i + len(g)]) for g in [next(iter(s))] for i in range(len(w) - len(g) + 1)}])

            assert set(after) == {d for d, r in before.items() if not leaks(r.text)} != set(before)
        if name != "mixing":
            assert docs.columns == table(spark, DIR, "documents").columns
    first = [r for r in kept["mixing"] if r.epoch == 0]
    assert sorted(r.doc_id for r in first) == sorted(last) and len({(r.source, r.place, r.slot) for r in first}) == len(first)


def test_repeated_rows_and_nulls(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text, "en", "a", 60), (5, text, "en", "a", 60), (5, "other words " * 5, "en", "a", 60), (7, text, "en", "b", 60), (None, text, None, None, None), (8, None, "en", "a", None), (9, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(5, min(text, "other words " * 5)), (0, text), (8, ""), (9, "")])


def test_near_duplicates_in_crowds(spark, tmp_path, monkeypatch):
    """Texts with one passage in common, all buckets crowded: pairs that share one or two bands leave one row."""
    monkeypatch.setattr(near_dups, "CROWD", 0)
    rng = random.Random(3)
    passage, pairs = " ".join(f"p{i}" for i in range(104)), []
    for _ in range(6000):
        own = [f"w{rng.randrange(10**6)}" for _ in range(28)]
        pairs += [f"{passage} {' '.join(own)}", f"{passage} {' '.join(own[:14])} {' '.join(f'v{rng.randrange(10**6)}' for _ in range(14))}"]
    keys = near_dups.bands(near_dups.registers(near_dups.shingle_sets(pa.array(pairs), 5)))
    few = (keys[::2] == keys[1::2]).sum(axis=1) <= 2
    texts = [x for i in range(6000) if 0 < (keys[2 * i] == keys[2 * i + 1]).sum() and (few[i] or i < 20) for x in pairs[2 * i : 2 * i + 2]]
    assert few.sum() > 3
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    least = groups({i: shingles(t, 5) for i, t in enumerate(texts)}, 80)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()} == {d for d, c in least.items() if d == c}
    assert len(set(least.values())) == len(texts) // 2


@pytest.mark.parametrize("crowd", [near_dups.CROWD, 0])
def test_near_duplicates_of_repeated_ids(spark, tmp_path, monkeypatch, crowd):
    """A doc_id with a short and a long text: each pair is held against the size of its own set, in buckets and by prefixes."""
    monkeypatch.setattr(near_dups, "CROWD", crowd)
    rng = random.Random(3)
    passage, pairs = " ".join(f"p{i}" for i in range(104)), []
    for _ in range(3000):
        own = [f"w{rng.randrange(10**6)}" for _ in range(28)]
        pairs += [f"{passage} {' '.join(own)}", f"{passage} {' '.join(own[:14])} {' '.join(f'v{rng.randrange(10**6)}' for _ in range(14))}"]
    keys = near_dups.bands(near_dups.registers(near_dups.shingle_sets(pa.array(pairs), 5)))
    common = (keys[::2] == keys[1::2]).sum(axis=1)
    rows = []
    for a, b, n in zip(pairs[::2], pairs[1::2], common):
        if n in (1, 2, 3):  # most meet in no bucket of their own
            at, long = 3 * (len(rows) // 4), [f"u{rng.randrange(10**7)}" for _ in range(900)]
            rows += [(at, a), (at, " ".join(long)), (at + 1, b), (at + 2, " ".join(long[:-3]))]
    least = groups({i: shingles(t, 5) for i, (_, t) in enumerate(rows)}, 80)
    assert len(rows) > 100 and all(least[i] == i - i % 4 + (i % 2) for i in range(len(rows)))
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == sorted({d for d, _ in rows if d % 3 == 0})
