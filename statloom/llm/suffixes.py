"""Suffix order of one shard by the difference cover modulo 3, and what is read off it."""

from __future__ import annotations

import numpy as np


def _pair(a: np.ndarray, b: np.ndarray, below: int) -> np.ndarray:
    """One integer per pair, ordered as the pairs; ``below`` is above every b."""
    top = int(a.max(initial=0)) + 1
    if top * below < 2**62:
        return a * below + b
    _, names = np.unique(a, return_inverse=True)
    if int(names.max(initial=0) + 1) * below < 2**62:
        return names * below + b
    raise OverflowError("shard too large for one key")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; a shorter suffix comes before a longer one that begins with it.

    The suffixes at positions 1 and 2 modulo 3 are sorted by their first triple, named, and sorted by recursion on the
    names. Those at 0 modulo 3 follow from one symbol and the rank of the next sampled suffix. Both orders are merged by
    counting, for each suffix at 0, the sampled ones before it.
    """
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:].tolist())), dtype=np.int64)
    _, named = np.unique(text, return_inverse=True)
    t = np.zeros(n + 4, dtype=np.int64)
    t[:n] = named + 1
    size = int(t.max()) + 1
    extra = n % 3 == 1  # then the empty suffix at n closes the first half of the names
    one, two = np.arange(1, n + extra, 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    triples = _pair(_pair(t[sampled], t[sampled + 1], size), t[sampled + 2], size)
    order = np.argsort(triples, kind="stable")
    ordered = triples[order]
    step = np.ones(len(ordered), dtype=np.int64)
    step[1:] = ordered[1:] != ordered[:-1]
    names = np.empty(len(sampled), dtype=np.int64)
    names[order] = np.cumsum(step)
    if int(step.sum()) < len(sampled):
        order = suffix_order(names)
    rank = np.zeros(n + 5, dtype=np.int64)
    by_rank = sampled[order]
    rank[by_rank] = np.arange(1, len(by_rank) + 1)
    by_rank = by_rank[by_rank < n]
    below = len(sampled) + 2
    zero = np.arange(0, n, 3)
    key1 = _pair(t[zero], rank[zero + 1], below)
    by_key = np.argsort(key1, kind="stable")
    zero, key1 = zero[by_key], key1[by_key]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    both = np.concatenate([zero, twos])
    pairs = _pair(_pair(t[both], t[both + 1], size), rank[both + 2], below)
    before = np.searchsorted(_pair(t[ones], rank[ones + 1], below), key1) if size * below < 2**62 else None
    if before is None:
        raise OverflowError("shard too large for one key")
    before = before + np.searchsorted(pairs[len(zero):], pairs[: len(zero)])
    out = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(zero))
    free = np.ones(n, dtype=bool)
    free[place] = False
    out[place] = zero
    out[free] = by_rank
    return out


def joined(parts: list[np.ndarray], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The parts one after the other with a separator behind each, and the start of each."""
    lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)])
    text = np.full(int(first[-1]), gap, dtype=np.int64)
    for p, at in zip(parts, first[:-1], strict=True):
        text[at: at + len(p)] = p
    return text, first[:-1]


def repeated_starts(text: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """For each position: it is ``valid`` and its ``window`` symbols also start at another valid position.

    Neighbours in suffix order are compared; suffixes that share a prefix stand together, and leaving out those that
    are too short does not part the others.
    """
    order = suffix_order(text)
    order = order[valid[order]]
    left, right = order[:-1], order[1:]
    same = np.arange(len(left))
    done = 0
    while done < window and len(same):
        step = min(8, window - done)
        ok = np.ones(len(same), dtype=bool)
        for j in range(done, done + step):
            ok &= text[left[same] + j] == text[right[same] + j]
        same = same[ok]
        done += step
    out = np.zeros(len(text), dtype=bool)
    out[left[same]] = True
    out[right[same]] = True
    return out
