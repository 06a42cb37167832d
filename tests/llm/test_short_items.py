"""Decontamination by items of few words, against brute force."""

import random

from augury.llm import decontam


def shingles(words, k):
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_short_items_in_long_documents(spark):
    rng = random.Random(7)
    texts = {d: [f"d{d}x{i}" for i in range(3000)] for d in range(20)}
    items = {}
    for n in range(1, 17):
        for j in range(40):
            d, at = rng.randrange(20), rng.randrange(2900)
            words = texts[d][at : at + n]
            if j % 4 == 3:  # one word changed
                words = words[: n // 2] + ["changed"] + words[n // 2 + 1 :]
            elif j % 4 == 2:  # one word more at the end
                words = [*words, "more"]
            items[n * 100 + j] = words
    items[9000] = ["again"] * 40  # one distinct shingle
    texts[99] = texts[0][:1500] + ["again"] * 6 + texts[0][1500:]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = set()
    for i, words in items.items():
        s = shingles(words, 5)
        for d, w in texts.items():
            both = len(s & shingles(w, min(5, len(words))))
            if 100 * both >= 80 * len(s):
                want.add((d, i))
    assert (99, 9000) in want and len(want) > 350
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()} == want
