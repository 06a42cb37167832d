"""The training-data operators against brute force on small tables with nulls, empty texts, copies and clashing columns."""

import hashlib
import re

from augury.llm import chunks, decontam, html_text, licenses, lines, mixing, near_dups, toxicity, urls, warc

WORDS = [f"w{i * 7919 % 997}" for i in range(400)]


def docs(spark):
    base = WORDS[:120]
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (0, " ".join(base), "a"), (1, " ".join(near), "a"), (2, " ".join(base), "b"), (3, " ".join(WORDS[200:300]), None),
        (4, None, "a"), (5, "", "b"), (6, "two words", "b"), (6, "two words", "b"), (None, "lost row", None), (8, "x " + " ".join(WORDS[120:200] * 30), "a"),
    ]
    return spark.createDataFrame([(i, t, s, 0, "k") for i, t, s in rows], "doc_id long, text string, source string, cnt int, key string")


def empty(spark):
    return docs(spark).filter("false")


def test_near_duplicates(spark):
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dups.near_duplicates(docs(spark)).collect()}
    assert got[1] == (0, False) and got[2] == (0, False) and got[0] == (0, True)
    assert all(got[i] == (i, True) for i in (3, 4, 5, 6, 8)) and got[None] == (None, True)
    assert near_dups.near_duplicates(empty(spark)).count() == 0


def test_licenses(spark):
    d = spark.createDataFrame([(1, "All Rights\nReserved. CC-BY"), (2, "Licensed under the Apache License, Version 2.0."), (3, None), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(d).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (5, 2, 0, 3, "cc-by,reserved")
    assert got[2]["labels"] == "apache" and got[2]["n_base"] == 0 and got[3]["n_words"] == 0
    assert licenses.scan(d.filter("false")).count() == 0


def test_toxicity_tolerates_gaps():
    clean = [f"the {a} and {b} went home" for a in WORDS[:20] for b in ("dog", "cat")]
    bad = [f"the {a} {b} went home" for a in WORDS[:20] for b in ("blockhead", "nitwit")]
    model = toxicity.fit(clean + bad, [0] * len(clean) + [1] * len(bad))
    s = model.score(["you b.lockhead", "a nit_wit here", "a quiet day", "", None])
    assert s[0] > 0.3 and s[1] > 0.3 and max(s[2:]) < 0.3


def test_html():
    page = "<nav><a href=x>Home</a></nav><div class=ad>Buy</div><article><p>One,&amp; two\n three.<p>Four<script>x('</p>')</script></article><footer>End</footer>"
    assert html_text.extract(page) == "One,& two three.\nFour"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>a</script>") == ""
    assert html_text.extract("<div>" * 5000 + "deep") == "deep"


def test_chunks(spark):
    rows = chunks.fingerprints(docs(spark), 3).collect()
    texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs(spark).collect()))
    want = []
    for k, (i, t) in enumerate(texts):
        u, h = texts[(k + 1) % len(texts)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == by[2]["fingerprint"] and by[4]["fingerprint"] == ""
    data = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(200))
    assert chunks.cuts(data)[-1] == len(data) and chunks.cuts(b"") == []
    assert chunks.fingerprints(empty(spark), 3).count() == 0


def test_urls(spark):
    d = spark.createDataFrame([(1, "http://A.example.org/es/x?y"), (2, "https://example.org/en/12"), (3, "http://b.com/de/"), (4, None), (5, "nothing"), (6, "http://org")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(d, urls.rules_table(spark)).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("com/de/", "block") and got[4] == got[5] == ("", "", None, "allow") and got[6] == ("org", "", None, "allow")


def test_lines(spark):
    d = spark.createDataFrame([(i, f"Menu\nbody {i}\n", "a") for i in range(20)] + [(99, None, "a"), (98, "Menu\nx", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup(d).collect()}
    assert got[3] == "body 3\n" and got[99] is None and got[98] == "Menu\nx"


def test_decontamination(spark):
    items = spark.createDataFrame([(1, " ".join(WORDS[130:170])), (2, "two words"), (3, None), (4, " ".join(WORDS[:50])), (5, "never seen at all here")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs(spark), items).collect()}
    assert got == {(8, 1), (6, 2), (0, 4), (1, 4), (2, 4)}
    assert sorted(r["doc_id"] or -1 for r in decontam.clean(docs(spark), items).collect()) == [-1, 3, 4, 5]


def test_warc(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "é" * 700
    d = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, None, None), (4, "u", inner * 2), (5, "u", "small"), (6, "u", "small")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(d).collect()}
    assert len(got) == 6 and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[2]["record_type"] == "response"
    assert bytes(got[4]["payload"]).decode() == inner * 2 and got[3]["payload_bytes"] == 0 and got[5]["record_type"] == got[6]["record_type"] == "response"


def test_mixing(spark):
    d = docs(spark)
    rows = mixing.mix(d, block=2).collect()
    assert sum(r["epoch"] == 0 for r in rows) == d.count()
    light = mixing.mix(d, carry=False).collect()
    assert abs(sum({r["source"]: r["weight"] for r in light}.values()) - 1) < 1e-6
    assert mixing.mix(empty(spark)).count() == 0
