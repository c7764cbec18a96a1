from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import filter_audit, line_runs, ranked_search
from statloom.sources.landing import land

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELS = "doc_id bigint, quality int, toxic int"
#: names that an operator could use for itself
CLASHES = ("h", "n", "slot", "shard", "block", "part", "failed", "word", "score", "item", "term", "owner", "batch", "hs", "lost", "lines", "digest", "good", "_rk", "id", "row")


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASHES if c not in df.columns})


# --- lines ---------------------------------------------------------------------------------------------------------------


def plain_lines(rows, least_docs, least_chars=1):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)

    texts = [(i, (t or "").split("\n")) for i, t in rows]
    held = Counter(k for _, ls in texts for k in {key(line) for line in ls} if len(k) >= least_chars)
    out = []
    for i, ls in texts:
        kept = [line for line in ls if held[key(line)] < least_docs]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found_lines(docs, **how):
    got = line_runs.without_common_lines(docs, **how).select("doc_id", "n_lines", "n_dropped", "text_left").collect()
    return sorted(map(tuple, got), key=str)


def line_rows(odd_rows):
    rng = random.Random(3)
    rows = list(odd_rows)
    for i in range(100, 160):
        lines = [rng.choice(["Menu", "  menu\t", "MENU", "About us", "É", "é", "", "x" * rng.randrange(1, 9), f"own {i}", "Ünique A"]) for _ in range(rng.randrange(0, 12))]
        rows.append((i, "\n".join(lines)))
    return [*rows, (200, "Menu\n" * 5000), (201, "\n"), (202, "a\n"), (203, "\r\nmenu\r\n")]


@pytest.mark.parametrize(("least_docs", "batches", "fanout"), [(10, 4, 2), (2, 5, 2), (1, 3, 3), (10**6, 1, 2)])
def test_common_lines_against_brute_force(documents, odd_rows, least_docs, batches, fanout):
    rows = line_rows(odd_rows)
    assert found_lines(clashing(documents(rows)), line_docs=least_docs, batches=batches, fanout=fanout) == plain_lines(rows, least_docs)


def test_short_keys_are_no_lines(documents, odd_rows):
    rows = line_rows(odd_rows)
    assert found_lines(documents(rows), line_docs=3, least_chars=3) == plain_lines(rows, 3, 3)


def test_lines_of_an_empty_table(documents):
    assert found_lines(documents([])) == []


def test_lines_of_the_sample(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert found_lines(sample) == plain_lines(rows, 10)


def counts(spark, pairs):
    return land(spark.createDataFrame(pairs, "h bigint, n bigint"))


def test_runs_are_levelled_and_leave_known_lines_out(spark):
    runs = line_runs.LineRuns(spark, limit=3, fanout=2, buckets=3)
    runs.add(counts(spark, [(1, 5), (2, 1)]))
    assert [len(level) for level in runs.levels] == [1]
    left = runs.without_common(counts(spark, [(1, 9), (2, 1), (4, 1)]))
    assert sorted(r.h for r in left.collect()) == [2, 4]
    for _ in range(2):
        runs.add(counts(spark, [(1, 9), (2, 1), (4, 1)]))
    assert [len(level) for level in runs.levels] == [1, 1]
    assert sorted(r.h for r in runs.common().collect()) == [1, 2]
    runs.add(counts(spark, [(5, 1)]))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    rows = {r.h: r.n for r in spark.table(runs.runs()[0]).collect()}
    assert rows == {1: 5, 2: 3, 4: 2, 5: 1}
    runs.close()


def test_with_a_limit_of_one_a_run_holds_the_lines_not_seen_before(spark):
    runs = line_runs.LineRuns(spark, limit=1, fanout=9, buckets=2)
    for batch in ([(1, 2), (2, 1)], [(2, 4), (3, 1)], [(1, 1), (3, 1), (4, 1)]):
        runs.add(counts(spark, batch))
    assert [sorted(r.h for r in spark.table(name).collect()) for name in runs.runs()] == [[1, 2], [3], [4]]
    runs.close()


def test_runs_are_merged_where_they_lie(spark):
    runs = line_runs.LineRuns(spark, limit=2, buckets=4)
    runs.add(counts(spark, [(1, 2)]))
    plan = runs.without_common(counts(spark, [(1, 1), (9, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "LeftAnti" in plan and "Bucketed: true" in plan
    runs.add(counts(spark, [(1, 1), (9, 1)]))
    two = runs._summed([*runs.runs(), *runs.runs()])
    assert sorted(map(tuple, two.collect())) == [(1, 4), (9, 2)]
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close()


# --- filters -------------------------------------------------------------------------------------------------------------


def test_bit_sums():
    rng = np.random.default_rng(1)
    for n in (0, 1, 15, 16, 1023, 1024, 16 * 1024, 16 * 1024 + 1, 70_000):
        words = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert filter_audit.bit_sums(words).tolist() == [int(((words >> np.uint32(b)) & 1).sum()) for b in range(32)]


def plain_audit(rows, labels):
    marks = {}
    for i, q, t in labels:
        a, b = marks.get(i, (False, False))
        marks[i] = (a or q == 1, b or t == 1)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
        failed = {
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None, "E": i is not None and least[t] < i,
        }
        docs.append((part or "", {f for f in failed if failed[f]}, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        mine, shapley = [d for d in docs if d[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_running_every_order(spark, odd_rows):
    rng = random.Random(9)
    rows = [(i, t, ["en", None, "de"][(i or 0) % 3]) for i, t in odd_rows]
    for i in range(50, 120):
        words = [rng.choice(["a", "b", f"w{rng.randrange(400)}", "Big", "NASA", "a#b"]) for _ in range(rng.choice([3, 190, 210, 260]))]
        rows.append((i, " ".join(words), rng.choice(["en", "fr", None, ""])))
    rows += [(i, "same text", "en") for i in range(300, 340)] + [(300, "same text", "en"), (None, "same text", "en")]
    labels = [(i, i % 2, (i + 1) % 3 % 2) for i in range(40, 330, 3)] + [(52, 1, 1), (52, 0, 0), (None, 1, 1), (55, None, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    marks = clashing(spark.createDataFrame(labels, LABELS))
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in filter_audit.filter_audit(docs, marks).collect()}
    assert got == plain_audit(rows, labels)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    rows = filter_audit.filter_audit(one, labels).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120


def test_many_parts_leave_a_task_in_portions(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_HELD", 3)
    rows = [(i, f"text {i}", f"p{i % 23}") for i in range(230)]
    got = filter_audit.filter_audit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame([], LABELS))
    assert {(r.part, r.removed) for r in got.where("filter_order = 'ABCDE' AND step = 1").collect()} == {(f"p{i}", 10) for i in range(23)}


# --- search --------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranks(rows, items, k=10):
    docs = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        scored = []
        for i, c, n in docs:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(text.translate(LOW))) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scored, key=str if False else lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=str)


def found_ranks(docs, items, **how):
    return sorted(map(tuple, ranked_search.ranked_documents(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def search_rows(odd_rows):
    rng = random.Random(4)
    common = ["the", "of", "and", "in"]
    rare = [f"r{i}" for i in range(300)] + ["Ñandú", "ñandú", "a_b", "x-y", "日本"]
    rows = list(odd_rows)
    for i in range(20, 420):
        rows.append((i, " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(rng.randrange(1, 60)))))
    rows += [(1000 + i, "The r1 r2 r3 of r4") for i in range(60)]
    items = [(j, " ".join(rng.choice(common + rare) for _ in range(rng.randrange(1, 30)))) for j in range(30)]
    return rows, [*items, (100, None), (101, ""), (102, "---"), (103, "r1 r1 R1 the"), (103, "r1 r1 R1 the"), (103, "r4"), (104, "nowhere"), (105, "The r1 r2 r3 of r4")]


@pytest.mark.parametrize("how", [{}, {"shard_docs": 16, "block_items": 4}, {"k": 3, "shard_docs": 40}])
def test_ranks_against_brute_force(spark, documents, odd_rows, how):
    rows, items = search_rows(odd_rows)
    docs, asked = clashing(documents(rows)), clashing(spark.createDataFrame(items, "item_id bigint, text string"))
    assert found_ranks(docs, asked, **how) == plain_ranks(rows, items, how.get("k", 10))


def test_search_in_empty_tables(spark, documents):
    none, one = spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert found_ranks(documents([]), one) == [] and found_ranks(documents([(1, "a")]), none) == [] and found_ranks(documents([(1, None), (2, " ")]), one) == []


def test_hash_of_the_query(spark, documents):
    got = line_runs.without_common_lines(documents([(1, "a\nb")])).select(F.sha2("text_left", 256)).first()[0]
    assert got == hashlib.sha256(b"a\nb").hexdigest()
