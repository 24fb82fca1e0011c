"""Groups equal those of an exact search over all pairs."""

import random
import re

import numpy as np
from cases import ODD

from loomnote.llm import minhash
from loomnote.llm.components import UnionFind, components
from loomnote.llm.shared import Tables

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    union = UnionFind()
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            common = len(a & b)
            if i is not None and j is not None and a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                union.union(i, j)
    out = []
    for i, a in sets:
        root = None if i is None else union.find(i)
        out.append((i, len(a), root, i is None or root == i))
    return sorted(out, key=str)


def corpus(seed, groups=12, size=12):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, number = [], 0
    shared = " ".join(rnd.choice(vocabulary) for _ in range(40))
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 160))]
        for _ in range(rnd.randrange(1, size)):
            copy = [rnd.choice(vocabulary) if rnd.random() < rnd.choice([0, 0.01, 0.03, 0.05]) else w for w in base]
            rows.append((number, " ".join(copy) + (" " + shared if rnd.random() < 0.3 else "")))
            number += 1
    rnd.shuffle(rows)
    return rows


def result(spark, table):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark, table).collect()), key=str)


def test_groups_equal_brute_force(spark, docs):
    rows = corpus(5) + [(1000 + i, t) for i, t in ODD if i is not None] + [(None, "no id here"), (2000, "One two"), (2001, "oNE  two"), (2002, "one two")]
    assert result(spark, docs(rows)) == brute(rows)


def test_one_large_group_of_near_copies(spark, docs):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if rnd.random() > 0.02 else f"e{rnd.random()}" for w in base)) for i in range(150)]
    assert result(spark, docs(rows)) == brute(rows)


def test_empty_table(spark, docs):
    assert result(spark, docs([])) == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            n = 200
            both = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, n - len(both)).astype(np.uint64)]) for _ in range(2))
            s = minhash.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            errors.append((s[0] == s[1]).mean() - len(both) / (2 * n - len(both)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.045


def test_every_slot_is_filled_for_tiny_sets():
    s = minhash.signatures(np.array([7, 7, 9], np.uint64), np.array([0, 1, 3, 3]))
    assert (s[:2] < minhash._FREE).all() and (s[2] == minhash._FREE).all()


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.concatenate([a[:250], rng.integers(0, 2**63, 40).astype(np.uint64)])
    p = minhash.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert sum(int(x).bit_count() for x in p[0] ^ p[1]) <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(8)
    got = {r.node: r.component for r in components(frame, Tables(spark), "chain").collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_rows_of_one_id_and_size_keep_all_links(spark, docs):
    one, two = ([f"{c}{i}" for i in range(60)] for c in "xy")
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (6, near(one)), (7, near(two)), (8, "alone " * 9)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, docs(rows)).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8}
