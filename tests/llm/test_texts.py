from __future__ import annotations

import hashlib
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from statloom.llm import extraction, licenses, mixing, pii, quality, toxicity
from statloom.sources.landing import land

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = (
        ("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", PHONE, lambda m: 10 <= len(digits(m)) <= 15),
    )
    for k, (kind, pattern, ok) in enumerate(tests):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return sorted(out)


PERSONAL = [
    (1, "mail a.b@c.d.e@f.g x+y@z.w.v 1.2.3.4.5.6.7.8 300.1.1.1 007.8.9.255"), (2, "4111 1111 1111 1111 call +1 (988) 555-2485 or +49-30-1234567."),
    (3, "é日 4111-1111-1111-1112 a@b 12 -34 +1 2"), (4, None), (5, ""), (6, "9" * 3000 + " " + "a." * 2000 + "@b" + ".c" * 2000), (7, "\x01x@y.z\x02"),
]


def test_personal_data(documents, sample):
    for docs in (documents(PERSONAL), sample):
        rows = pii.personal_data(docs)
        base, every = pii.span_lists(rows)
        got = {r.doc_id: (r.b, r.s) for r in rows.select("doc_id", base.alias("b"), every.alias("s")).collect()}
        for r in docs.collect():
            want = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base_spans(r.text))
            assert got[r.doc_id][0] == want
            assert set(want.split(",")) <= set(got[r.doc_id][1].split(",")) or not want
    assert pii.personal_data(sample.limit(0)).isEmpty()


def test_redaction(documents):
    out = {r.doc_id: r.text for r in pii.redacted(documents([(1, "to a@b.cd now"), (2, None), (3, "none")])).collect()}
    assert out == {1: "to <email> now", 2: None, 3: "none"}


def test_licences(documents, sample):
    rows = [(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0. mit license"), (3, None), (4, "general public"), (5, "Licensed under CC BY-NC 4.0.")]
    for docs in (documents(rows), sample):
        got = {r.doc_id: r for r in licenses.scan_licences(docs).collect()}
        for r in docs.collect():
            low = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            want = sorted((i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
            assert (got[r.doc_id].n_words, sorted((b["at"], b.label) for b in got[r.doc_id].base)) == (len(words), want)
    found = {r.doc_id: {x.label for x in r.labels} for r in licenses.scan_licences(documents(rows)).collect()}
    assert "apache-2.0" in found[2] and "cc-by-nc-4.0" in found[5] and not found[3] and not found[4]
    assert licenses.scan_licences(sample.limit(0)).isEmpty()


def test_licence_headers(documents):
    gnu = "This {} is free software; you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation; either version {} of the License, or (at your option) any later version."
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    rows = [(1, gnu.format("program", "", "3")), (2, gnu.format("program", "", "2")), (3, gnu.format("library", "Lesser ", "2.1")), (4, gnu.format("program", "Affero ", "3")), (5, mit),
            (6, "This work is under a Creative Commons Attribution-ShareAlike 4.0 International License."), (7, "MIT License. " + mit)]
    found = {r.doc_id: [x.label for x in r.labels] for r in licenses.scan_licences(documents(rows)).collect()}
    assert found == {1: ["gpl-3.0"], 2: ["gpl-2.0"], 3: ["lgpl-2.1"], 4: ["agpl-3.0"], 5: ["mit"], 6: ["cc-by-sa-4.0"], 7: ["mit"]}


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_quality(documents, sample, odd_rows):
    for docs in (documents(odd_rows), sample):
        got = Counter((r.doc_id, tuple(r[m] for m in quality.MEASURES)) for r in quality.quality_rules(docs).collect())
        assert got == Counter((r.doc_id, measures(r.text)) for r in docs.collect())
    assert quality.quality_rules(sample.limit(0)).isEmpty()


def test_common_lines(documents):
    own = lambda i: " ".join(f"word{i}n{j}" for j in range(12))
    rows = [(2 * i, f"Read  MORE news here today and every single day\n{own(i) if i % 2 else 'few words'}") for i in range(60)]
    got = {r.doc_id: (r.n_common_words, r.kept) for r in quality.quality_rules(documents(rows)).collect()}
    assert got == {2 * i: (9, True) if i % 2 else (9 + 2, False) for i in range(60)}


def test_common_lines_of_a_large_host(documents):
    body = lambda i: " ".join(f"word{i}n{j}" for j in range(12))
    rows = [(2 * i, f"{body(i)}\n\nShared  LINE of\tthis host\n" if i < 25 else body(i)) for i in range(1000)]
    rows += [(3000, "shared line of this host"), (3002, f"shared line of this host\n{body(3002)}\nshared line of this host"), (3001, "shared line of this host")]
    left = {r.doc_id: r.text_left for r in quality.texts_without_common_lines(documents(rows)).collect()}
    got = {r.doc_id: (r.n_common_words, r.kept, left[r.doc_id]) for r in quality.quality_rules(documents(rows)).collect()}
    want = {2 * i: (5, True, f"{body(i)}\n\n") if i < 25 else (0, True, body(i)) for i in range(1000)}
    assert got == want | {3000: (5, False, ""), 3002: (10, False, body(3002)), 3001: (0, False, "shared line of this host")}


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=a>Home</a></nav><div class="cookie-notice">We use cookies, ok.</div>
<div id=content><h2>Head</h2><p>First   part, with <b>bold<br>text &amp; &eacute;&#8364;<p>Second part, longer, and so on.</div><div class="sidebar"><p>Side, side, side</p></div>
<form><p>Subscribe, now</p></form><div class=comments><p>Nice, article, friend</p></div><script>var p = "<p>no</p>";</script><footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    assert extraction.main_text(PAGE) == "Head First part, with bold text & é€ Second part, longer, and so on."
    assert extraction.main_text("") == "" and extraction.main_text("<div><p>a<p>b") == "a b" and extraction.main_text("plain < text") == "plain < text"
    assert extraction.main_text("<div>" * 20_000 + "deep") == "deep"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "x", ""), (3, "y", "<p>one</p>")], "page_id bigint, url string, html string")
    assert {(r.page_id, r.n_chars) for r in extraction.extract_pages(pages).collect()} == {(1, 68), (2, 0), (None, 0), (3, 3)}
    assert extraction.extract_pages(pages.limit(0)).isEmpty()


def test_extraction_keeps_the_rest_of_the_article():
    body = "<div class=body>" + "".join(f"<p>Paragraph {i}, with commas, and more, and so on, until it is long enough.</p>" for i in range(12)) + "</div>"
    text = extraction.main_text(body)
    page = f"<body><div id=content><div class=lead><p>Short lead.</p></div>loose <b>words</b>{body}<ul><li>one<li>two</ul><blockquote>Said.</blockquote><div><a href=x>More</a> <a href=y>pages</a></div></div></body>"
    assert extraction.main_text(page) == f"Short lead. loose words {text} one two Said."
    for name in ("discussion", "related-work", "search"):
        assert extraction.main_text(f"<div>{body}<div id={name}><p>Section of the text.</p></div></div>") == f"{text} Section of the text."
        assert extraction.main_text(f"<div>{body}<div id={name}><p>Find <a href=x>this page</a> and <a href=y>that page</a></p></div></div>") == text
        assert extraction.main_text(f"<div>{body}<div id={name}><p>Look here</p><p><form><input></form></p></div></div>") == text
    assert extraction.main_text(f"<div><svg class='x' />{body}<object data='y'/><p>End.</p></div>") == f"{text} End."


def test_grammar():
    machine, words = toxicity.grammar(), toxicity.Reader(toxicity.fixed_words())
    score = lambda t: sum(toxicity.clause_scores(t, machine, words))
    assert score("You are an idiot") > score("An idiot") > score("They said he is an idiot") > score("You are not an idiot") > score("fine words") == 0
    assert score("I will kill you") < score("you they will kill") and score("kill time") < 0.5 and score("") == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.op1(spark, d).where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    caught = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in caught) >= 0.9 * len(caught) and sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_toxicity_of_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1), (7, 0, 1), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs = documents(odd_rows)
    got = toxicity.with_toxicity(docs, labels)
    assert got.count() == len(odd_rows) and got.columns[:5] == docs.columns and got.where("_score IS NULL OR _score > 1 OR _score < 0").isEmpty()
    assert toxicity.with_toxicity(docs.limit(0), labels.limit(0)).isEmpty()


def test_raking(spark, documents, odd_rows):
    cells = spark.createDataFrame([("a", "x", "p", 90), ("a", "y", "q", 10), ("b", "x", "q", 30), ("b", "y", "p", 70)], "source string, lang string, topic string, tokens bigint")
    share = lambda axis, values: spark.createDataFrame(list(values.items()), f"{axis} string, target double")
    targets = {"source": share("source", {"a": 0.3, "b": 0.7}), "lang": share("lang", {"x": 0.5, "y": 0.5}), "topic": share("topic", {"p": 0.6, "q": 0.4})}
    got = mixing.raked(cells, targets).collect()
    total = sum(r.tokens * r.weight for r in got)
    for axis, want in (("source", {"a": 0.3, "b": 0.7}), ("lang", {"x": 0.5, "y": 0.5}), ("topic", {"p": 0.6, "q": 0.4})):
        for k, v in want.items():
            assert abs(sum(r.tokens * r.weight for r in got if r[axis] == k) / total - v) < 1e-4
    docs = documents(odd_rows)
    mixed = mixing.mixed(docs)
    assert mixed.count() == len(odd_rows) and mixed.where("_copies IS NULL").isEmpty() and mixing.mixed(docs.limit(0)).isEmpty()
    assert mixed.where("_tokens = 0 AND _copies > 0").isEmpty()
    blank = mixing.mixed(docs.withColumn("text", F.lit(" ")))
    assert blank.count() == len(odd_rows) and blank.where("_copies IS NULL OR _copies > 0 OR _weight IS NULL").isEmpty()


def test_raking_plans_stay_small(spark, monkeypatch):
    """The driver keeps the plan of every query that ran: a step of the raking has one join, whatever the number of axes."""
    joins = []

    def landed(df):
        joins.append(str(df._jdf.queryExecution().analyzed().toString()).count("Join "))
        return land(df)

    monkeypatch.setattr(mixing, "land", landed)
    cells = spark.createDataFrame([("a", "x", "p", 10), ("a", "y", "q", 30), (None, "x", "q", 25), ("b", "y", "p", 35)], "source string, lang string, topic string, tokens bigint")
    got = mixing.raked(cells, {a: mixing.target_shares(cells, a, 0.5) for a in mixing.AXES}, rounds=2, tolerance=0.0).collect()
    assert got and len(joins) == 7 and max(joins[1:]) == 1
    sums = mixing.target_shares(cells, "topic", 0.5).collect()
    for r in sums:
        assert abs(sum(x.tokens * x.weight for x in got if x.topic == r.topic) / 100 - r.target) < 1e-9


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        rows = out.collect()
        assert {r.doc_id for r in rows} <= kept
        kept = {r.doc_id for r in rows}
        if name != "mixing":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, out.schema)
    assert rows and corpus_pipeline.run(spark, d).count() == len(rows)


def test_digest_helpers():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" and F is not None


def test_personal_data_trees_read_all_labelled_candidates(documents, monkeypatch):
    docs = documents([(i, f"host {i % 250}.{i % 199}.{i % 7}.{i % 300 + 1} tel +49 30 {1234567 + i} or {i}.{i}") for i in range(400)])
    seen = []
    fit = pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    pii.personal_data(docs).count()
    labels = pii.candidates(pii.keyed(docs)).withColumn("label", pii._weak_label()).where("label IS NOT NULL")
    want = labels.dropDuplicates([*pii.KEY, "kind", "s"]).where(F.pmod(F.xxhash64("m"), F.lit(3)) > 0).count()
    assert seen == [want] and want > 0
    assert "train_rows" not in pii.personal_data.__annotations__
