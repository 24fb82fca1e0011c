"""Runs equal those found by trying every period and every start."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from cases import ODD
from test_hashes import thue_morse

from loomnote.llm import runs


def brute(words):
    """(start, length, period) of every run, by scanning each period for stretches of equal pairs."""
    best, n = {}, len(words)
    for p in range(n // 2, 0, -1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                best[i, j + p] = p  # periods descend, so the smallest stays
            i = j
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def brute_digests(rows):
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        h = crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        s, n, p = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join("%d,%d,%d\n" % r for r in found)
        out.append((doc, len(found), s, n, p, None if s is None else 1000 * n // p, sha256(lines.encode()).hexdigest(), sha256(left).hexdigest()))
    return sorted(out, key=str)


def stretches(seed, count):
    rnd = random.Random(seed)
    made = []
    for _ in range(count):
        out = []
        while len(out) < rnd.randrange(0, 150):
            part = [rnd.randrange(rnd.choice([1, 2, 5, 50])) for _ in range(rnd.randrange(1, 20))]
            out += (part * rnd.randrange(1, 7))[: rnd.randrange(1, 90)]
        made.append(out)
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 400:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    return [*made, fibonacci[1], [ord(c) for c in thue_morse(512)], [7] * 300, [1, 2] * 100, [1, 2, 1, 2, 3] * 40, [], [5], list(range(200))]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    texts = stretches(seed, 60)
    sizes = np.array([len(t) for t in texts])
    words = np.array([w for t in texts for w in t], np.int64)
    start, length, period = runs.find(words, sizes)
    begin = np.cumsum(sizes) - sizes
    want = [(int(b) + s, n, p) for b, t in zip(begin, texts, strict=True) for s, n, p in brute(t)]
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_common_lengths():
    rnd = random.Random(4)
    words = np.array([rnd.randrange(2) for _ in range(400)] * 2, np.int64)
    row = np.repeat([0, 1], [500, 300])
    names = runs.Names(words, row)
    i, j = (np.array([rnd.randrange(800) for _ in range(3000)]) for _ in range(2))
    same = row[i] == row[j]
    i, j = i[same & (i != j)], j[same & (i != j)]
    for a, b, n, m in zip(i.tolist(), j.tolist(), names.forward(i, j).tolist(), names.backward(i, j).tolist(), strict=True):
        k = 0
        while max(a, b) + k < 800 and row[a + k] == row[b + k] == row[a] and words[a + k] == words[b + k]:
            k += 1
        assert n == k
        k = 0
        while min(a, b) - k > 0 and row[a - k - 1] == row[b - k - 1] == row[a] and words[a - k - 1] == words[b - k - 1]:
            k += 1
        assert m == k


def test_query_equals_brute_force(spark, docs):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([" ", "\n", " \t "]).join(f"é{w}" for w in t)) for i, t in enumerate(stretches(9, 120))]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(ODD) if t is None or len(t) < 100_000] + [(None, "again " * 40), (3, "again and " * 30), (3, "again and " * 30)]
    got = runs.audit(spark, docs(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_digests(rows)


def test_outputs_and_long_texts(spark, docs):
    long = " ".join(f"w{i}" for i in range(3000)) + " " + "tick tock " * 50_000
    rows = [(1, "a b c " * 10 + "d"), (2, None), (3, long), (4, "x " * 200_000)]
    got = {r.doc_id: r for r in runs.periodic_runs(spark, docs(rows)).collect()}
    assert (got[1].starts, got[1].lengths, got[1].periods, got[1].collapsed) == ([0], [30], [3], "a b c d")
    assert (got[2].n_words, got[2].n_runs, got[2].collapsed) == (0, 0, "")
    assert (got[3].starts, got[3].lengths, got[3].periods) == ([3000], [100_000], [2]) and got[3].collapsed.endswith("w2999 tick tock")
    assert (got[4].lengths, got[4].periods, got[4].collapsed) == ([200_000], [1], "x")
    assert runs.periodic_runs(spark, docs([])).count() == runs.audit(spark, docs([])).count() == 0
