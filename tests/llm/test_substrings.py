from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from statloom.llm import arrays, fm_dedup, routing, suffix_dedup
from statloom.llm.suffixes import suffix_order


def brute(rows, window, by_word):
    """(doc_id, symbols, removed, runs, digest of what is left) for each row."""
    seqs = [(t or "").encode().split() if by_word else (t or "").encode() for _, t in rows]
    cut = [[tuple(s[i:i + window]) if by_word else s[i:i + window] for i in range(len(s) - window + 1)] for s in seqs]
    seen = Counter(w for ws in cut for w in ws)
    out = []
    for (doc, _), s, ws in zip(rows, seqs, cut, strict=True):
        gone = np.zeros(len(s) + 1, dtype=int)
        for i, w in enumerate(ws):
            if seen[w] > 1:
                gone[i] += 1 if i + window > len(s) else 0
                gone[i:i + window] = 1
        kept = [x for x, g in zip(s, gone, strict=False) if not g]
        runs = sum(1 for i in range(len(s)) if gone[i] and (i == 0 or not gone[i - 1]))
        body = b" ".join(kept) if by_word else bytes(kept)
        out.append((doc, len(s), int(sum(gone[: len(s)])), runs, hashlib.sha256(body).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_suffix_order(text):
    assert suffix_order(np.array(text, dtype=np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_matching_statistics():
    text = np.array([3, 1, 2, 1, 2, 3, 1, 2, 0])
    found = fm_dedup.WaveletIndex(text).matching_statistics(text, np.arange(1, 9), 8)
    held = text.tolist()

    def longest(end):
        return max((k for k in range(1, end + 1) if sum(held[i:i + k] == held[end - k:end] for i in range(len(held) - k + 1)) > 1), default=0)

    assert found.tolist() == [longest(e) for e in range(1, 9)]


def test_bytes_on_the_sample(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    got = suffix_dedup.remove_repeated_bytes(sample).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 200, False)


def test_words_on_the_sample(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    got = fm_dedup.remove_repeated_words(sample).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == [(a, b, c, e) for a, b, c, _, e in brute(rows, 35, True)]


def test_odd_rows(documents, odd_rows):
    odd = documents(odd_rows).withColumnRenamed("lang", "s").withColumnRenamed("source", "body")
    got = suffix_dedup.remove_repeated_bytes(odd, 20).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(odd_rows, 20, False)
    got = fm_dedup.remove_repeated_words(odd, 5).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == [(a, b, c, e) for a, b, c, _, e in brute(odd_rows, 5, True)]
    assert suffix_dedup.remove_repeated_bytes(odd.limit(0)).isEmpty()


def test_hot_minimizers_take_the_counting_way(documents):
    """A passage in many texts: its borders are more than a shard takes, and the answer is the same."""
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(9)) + " " + passage + " " + " ".join(f"b{i}x{j}" for j in range(9))) for i in range(40)]
    unit = routing.Unit(window=10, gram=4, by_word=True, shard=2_000, hot=3)
    from statloom.llm.base import keyed

    spans = routing.repeated_spans(keyed(documents(rows)), unit, fm_dedup.shard_index).collect()
    covered = {}
    for r in spans:
        covered.setdefault(r.doc_id, []).append((r.s, r.e))
    assert all(arrays.merged(np.array(covered[i])).tolist() == [[9, 49]] for i in range(40))


def test_hot_windows_are_decided_in_blocks(documents, monkeypatch):
    """Few windows of a passage are counted one by one; its copies with another word inside lose what they share."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        inside = list(passage)
        if i % 3 == 0:
            inside[int(rng.integers(0, 60))] = f"e{i % 12}"
        rows.append((i, " ".join([f"a{i % 20}x{j}" for j in range(30)] + inside + [f"b{i}x{j}" for j in range(30)])))
    rows.append((None, " ".join(passage * 3)))
    made = {}
    land = routing.land

    def spy(df):
        out = land(df)
        made[tuple(out.columns)] = out
        return out

    monkeypatch.setattr(routing, "land", spy)
    unit = routing.Unit(window=20, gram=4, by_word=True, shard=2_000, hot=3)
    from statloom.llm.base import keyed

    spans = routing.repeated_spans(keyed(documents(rows)), unit, fm_dedup.shard_index).collect()
    covered = {}
    for r in spans:
        covered.setdefault(r.doc_id, []).append((r.s, r.e))
    expected = {doc: runs for doc, _, removed, runs, _ in brute(rows, 20, True) if removed}
    cut = {doc: removed for doc, _, removed, _, _ in brute(rows, 20, True) if removed}
    merged = {i: arrays.merged(np.array(v)) for i, v in covered.items()}
    assert {i: int((v[:, 1] - v[:, 0]).sum()) for i, v in merged.items()} == cut
    assert {i: len(v) for i, v in merged.items()} == expected
    blocks = next(d for c, d in made.items() if "core" in c and "k" not in c)
    named = next(d for c, d in made.items() if "w" in c and "single" in c)
    assert 3 * named.count() < blocks.agg({"size": "sum"}).first()[0]
