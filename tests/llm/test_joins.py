from __future__ import annotations

import random

import numpy as np

from statloom.llm import decontaminate, ngram_join

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").translate(LOW).encode().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, ngram_join.shingle_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_components_on_the_sample(sample):
    assert found(sample) == components([(r.doc_id, r.text) for r in sample.collect()])


def test_near_copies_in_a_large_group(documents):
    rng = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(base[:60]) + " " + " ".join(f"z{i}y{j}" for j in range(60))) for i in range(40)]
    assert found(documents(rows)) == components(rows)


def test_sets_of_exact_copies_are_landed_once(documents, monkeypatch):
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(base) + (" end" if i % 2 else " stop")) for i in range(80)]
    landed = []

    def spy(df):
        out = ngram_join_land(df)
        if out.columns == ["v", "tokens"]:
            landed.append((out.count(), out.select("v").distinct().count()))
        return out

    ngram_join_land = ngram_join.land
    monkeypatch.setattr(ngram_join, "land", spy)
    assert found(documents(rows).repartition(8)) == components(rows)
    assert landed and all(n == vertices == 2 for n, vertices in landed)


def test_odd_rows(documents, odd_rows):
    docs = documents(odd_rows).withColumnRenamed("source", "label").withColumnRenamed("lang", "v")
    assert found(docs) == components(odd_rows)
    assert ngram_join.shingle_components(docs.limit(0)).isEmpty()
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.one_of_each_group(docs).collect()), key=str)
    wordless = [r for r in odd_rows if not (r[1] or "").split()]
    long, period = odd_rows[4][1], odd_rows[7][1]
    assert kept == sorted([*wordless, (4, long), (6, period), (7, "one two"), odd_rows[10], odd_rows[11]], key=str)


def test_decontamination(spark, documents):
    item = " ".join(f"Q{i}" for i in range(14))
    rows = [(1, "x " + item.lower() + " y"), (2, " ".join(item.split()[2:12])), (3, " ".join(item.split()[:9])), (4, None), (5, ""), (6, "short ITEM; here"), (6, "short ITEM; here"), (None, "a short-item b")]
    items = spark.createDataFrame([(7, item), (10, item), (2, "short item"), (3, ""), (4, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.contaminated_documents(documents(rows), items).collect()}
    assert got == {(1, 16, 14, ("10", "7")), (2, 10, 10, ("10", "7")), (3, 9, 0, ()), (4, 0, 0, ()), (5, 0, 0, ()), (6, 3, 2, ("2",)), (None, 4, 2, ("2",))}
    clean = decontaminate.decontaminated(documents(rows), items)
    assert sorted((r.doc_id for r in clean.collect())) == [3, 4, 5] and clean.columns == documents(rows).columns
    assert decontaminate.contaminated_documents(documents(rows).limit(0), items).isEmpty()
    assert decontaminate.contaminated_documents(documents(rows), items.limit(0)).where("contaminated").isEmpty()


def test_proximity_is_told_from_phrases(spark, documents):
    words = [f"q{i}" for i in range(10)]
    loose = [w for pair in zip(words, ["x"] * 10, strict=True) for w in pair][:19]
    rows = [(1, " ".join(words)), (2, " ".join(words[:4] + ["x"] + words[4:])), (3, " ".join(loose)), (4, " ".join(words[:2])), (5, "x " * 40)]
    items = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    got = {r.doc_id: (r.contaminated, r.n_near) for r in decontaminate.contaminated_documents(documents(rows), items).collect()}
    # two: one word more inside; three: every other word is another, the deciding ones stand at most two places from their own
    assert got == {1: (True, 0), 2: (False, 1), 3: (False, 1), 4: (False, 0), 5: (False, 0)}


def test_index_is_intersected_where_documents_lie(spark, documents):
    docs = decontaminate.keyed(documents([(i, f"q1 q2 q{i} x") for i in range(30)])).repartition("doc_id", "_rk")
    anchors = decontaminate.land(spark.createDataFrame([("q1", 1), ("q2", 2)], "word string, at int"))
    index = decontaminate.token_places(docs, anchors.select("word"))
    plan = index.join(anchors, "word").groupBy("doc_id", "_rk", "at").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1


def test_sets_of_a_slice_are_made_together():
    texts = [b"", b"a b", b"a b c d e f a b c d e f", b"  ", b"A b C d e F"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tokens, at = ngram_join.token_sets(np.frombuffer(b"".join(texts), dtype=np.uint8), off, 5)
    assert np.diff(at).tolist() == [0, 1, 6, 0, 2]
    sets = [tokens[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert all(s == sorted(set(s)) for s in sets) and set(sets[4]) <= set(sets[2])
    names = ngram_join._set_names(tokens, at)
    assert names[0] == names[3] == 0 and len(set(names.tolist())) == 4
    alone, bounds = ngram_join.token_sets(np.frombuffer(texts[2], dtype=np.uint8), np.array([0, len(texts[2])]), 5)
    assert alone.tolist() == sets[2] and ngram_join._set_names(alone, bounds)[0] == names[2]
    assert ngram_join._sketches(tokens, at)[2].tolist() == ngram_join._sketches(alone, bounds)[0].tolist()
    assert ngram_join._firsts(tokens, at)[1].tolist() == ngram_join._firsts(alone, bounds)[0].tolist()


def test_shuffle_files_end_with_the_landing(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(b.name().startswith("shuffle") for b in (store.getAllBlocks().apply(i) for i in range(store.getAllBlocks().size())))
    before = held()
    landed = ngram_join.land(spark.range(1000).repartition(7).groupBy((ngram_join.F.col("id") % 10).alias("k")).count())
    assert held() <= before and landed.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_components_are_made_once(documents, monkeypatch):
    """What leaders brought together is not joined into components a second time."""
    calls = []
    made = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda links: (calls.append(1), made(links))[1])
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, text + " more words"), (4, "quite another text of seven words")]
    assert found(documents(rows)) == components(rows)
    assert len(calls) == 1


def landed_folders(spark):
    from pathlib import Path

    from statloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return {p.name for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("landed-*")}


def read_by(*frames):
    return {x for df in frames for f in df.inputFiles() for x in f.split("/") if x.startswith("landed-")}


def test_only_landed_tables_that_a_result_reads_stay(spark, documents):
    """Each stage of the pipeline leaves no table behind that its result does not read."""
    from statloom.llm.mixing import mixed
    from statloom.llm.pii import redacted
    from statloom.llm.toxicity import with_toxicity

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, text + " more words"), (3, text + " more words"), (4, "mail a.b@c.org or 10.0.0.1 now"), (5, None)]
    docs = documents(rows)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([("q", "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id string, text string")
    stages = {
        "toxicity": (lambda: with_toxicity(docs, labels), 6), "near copies": (lambda: ngram_join.one_of_each_group(docs), 3),
        "benchmark": (lambda: decontaminate.decontaminated(docs, items), 2), "personal data": (lambda: redacted(docs), 6), "mixing": (lambda: mixed(docs), 6),
    }
    for name, (stage, n) in stages.items():
        before = landed_folders(spark)
        out = stage()
        assert landed_folders(spark) - before == read_by(out), name
        assert out.count() == n, name


def test_what_a_block_leaves_passes_to_the_block_around(spark):
    from statloom.sources.landing import land, landings

    before = landed_folders(spark)
    with landings() as outer:
        first = land(spark.range(3))
        with landings() as inner:
            second, third = land(spark.range(4)), land(spark.range(5))
            inner.only(second)
            assert first.count() == 3 and second.count() == 4 and landed_folders(spark) - before == read_by(first, second)
        both = second.union(land(spark.range(6)))
        outer.only(both)
        assert landed_folders(spark) - before == read_by(both) and len(read_by(both)) == 2
        outer.only()
    assert landed_folders(spark) == before and third is not None


def test_sieves_end_when_what_read_them_is_landed(spark, documents, monkeypatch):
    made, one, several = [], ngram_join.sieve_of, ngram_join.sieves_of
    monkeypatch.setattr(ngram_join, "sieve_of", lambda *a: (made.append(one(*a)), made[-1])[1])
    monkeypatch.setattr(ngram_join, "sieves_of", lambda *a: (made.extend(out := several(*a)), out)[1])
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, "quite another text of seven words")]
    assert found(documents(rows)) == components(rows)
    assert len(made) >= 10 and not any(b._jbroadcast.isValid() for b in made)


def test_sieves_made_in_one_pass(spark):
    rows = spark.createDataFrame([(i * 2654435761 * (-1) ** i, i) for i in range(1, 200)], "t bigint, k int")
    levels = ["k >= 2", "k >= 24", "k >= 500"]
    for sieve, level in zip(ngram_join.sieves_of(rows, "t", *levels), levels, strict=True):
        alone = ngram_join.sieve_of(rows.where(level), "t")
        assert np.array_equal(sieve.value, alone.value)
        t = np.array([r.t for r in rows.where(level).collect()], dtype=np.int64)
        assert ngram_join.passes(sieve.value, t).all()
