"""Notes with equal word sets are compared once, and each pair of them is still told."""

import itertools
import random

from loomnote.operators import memory


def test_copies_equal_brute_force_and_do_not_multiply_candidates(spark, monkeypatch):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    base = [rnd.sample(words, 20) for _ in range(6)]
    texts = [" ".join(rnd.sample(base[i % 6], 20)) for i in range(60)] + [" ".join([*base[i % 6][:18], f"x{i}"]) for i in range(12)]
    notes = [(f"n{i}", "fact" if i % 3 else "policy", t) for i, t in enumerate(texts)] + [("e", "fact", ""), ("z", None, texts[0])]
    want = set()
    for (p, k, t), (q, l, u) in itertools.combinations(notes, 2):
        a, b = set(t.split()), set(u.split())
        if k and k == l and a and b and round(len(a & b) / len(a | b), 6) >= 0.8:
            want.add((min(p, q), max(p, q), round(len(a & b) / len(a | b), 6)))
    sizes, keep = [], memory.cut
    monkeypatch.setattr(memory, "cut", lambda rows: (lambda out: (sizes.append((out.columns, out.count())), out)[1])(keep(rows)))
    found = memory.near_words(spark.createDataFrame(notes, "path string, type string, text string"), 0.8)
    got = [(r.a, r.b, r.overlap) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert next(n for c, n in sizes if c == ["a", "b"]) < 100 < len(want)
