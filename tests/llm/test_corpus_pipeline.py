"""The corpus pipeline as a whole, on a small corpus of its own."""

import corpus_pipeline
from augury.llm import lines

WORDS = [f"w{i * 7919 % 997}" for i in range(900)]


def corpus(spark, path, extra):
    """Unlike documents 0..59 with a menu line, ten rude ones, and ``extra`` (doc_id, text) of the same source."""
    rows = [(i, "\n".join(["Home About Contact", " ".join(WORDS[i * 14 : i * 14 + 7]), " ".join(WORDS[i * 14 + 7 : i * 14 + 14])])) for i in range(60)]
    rows += [(100 + i, f"you {WORDS[i]} blockhead nitwit {WORDS[i + 50]} blockhead") for i in range(10)] + extra
    docs = [(i, t, "en", "a", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "an item that no document holds at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_a_group_of_copies_stays_as_one_whole_document(spark, tmp_path):
    text = "\n".join(" ".join(WORDS[860 + 8 * j : 868 + 8 * j]) for j in range(4))
    copies = [(200 + i, text + "\n" * (i % 3)) for i in range(30)]
    got = [r for r in corpus_pipeline.run(spark, corpus(spark, tmp_path, copies)).collect() if r["epoch"] == 0]
    assert [(r["doc_id"], r["text"]) for r in got if r["doc_id"] >= 200] == [(200, text)]
    plain = [r for r in got if r["doc_id"] < 60]
    assert len(plain) > 50 and not any("Home" in r["text"] for r in plain)


def test_copies_vote_once_in_both_counts(spark):
    rows = [(i, "copy\nof a page") for i in range(50)] + [(100 + i, f"Menu\nbody {i}") for i in range(5)] + [(200 + i, f"own {i}") for i in range(100)]
    d = spark.createDataFrame([(i, t, "a") for i, t in rows], "doc_id long, text string, source string")
    once = {r["doc_id"]: r["text"] for r in lines.dedup(d, copies=False).collect()}
    assert once[3] == "copy\nof a page" and once[101] == "body 1"
    every = {r["doc_id"]: r["text"] for r in lines.dedup(d).collect()}
    assert every[3] == ""
    assert {r["total"] for r in lines.boilerplate(d, copies=False).collect()} == {106}
