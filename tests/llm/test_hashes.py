"""Different texts are never taken for equal, however regular they are."""

import numpy as np
import pytest
from test_decontaminate import brute as brute_overlap
from test_lines_and_passages import brute_all_lines, brute_passages, key
from test_minhash import brute as brute_groups

from loomnote.llm import bytetext as bt
from loomnote.llm import decontaminate, linededup, minhash, passages


def thue_morse(n, one="a", two="b"):
    return "".join(two if i.bit_count() & 1 else one for i in range(n))


@pytest.fixture(params=[1024, 2048, 8192])
def pair(request):
    return thue_morse(request.param), thue_morse(request.param, "b", "a")


def test_regular_lines_stay_apart(spark, docs, pair):
    rows = [(1, pair[0]), (2, pair[1]), (3, pair[0] + "\n" + pair[1][:500] + "x" + pair[1][501:])]
    assert {r.doc_id: r.text for r in linededup.dedup_lines(spark, docs(rows)).collect()} == brute_all_lines(rows)


def test_regular_words_stay_apart(spark, docs, pair):
    rows = [(i, " ".join([pair[i % 2]] * 13 + [f"w{i % 2}"] * 3)) for i in range(4)] + [(9, " ".join(pair[0])), (10, " ".join(pair[1]))]
    got = passages.remove_repeats(spark, docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=lambda r: (key(r[0]), r[3])) == brute_passages(rows)
    got = minhash.near_duplicates(spark, docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute_groups(rows)
    items = [(1, " ".join([pair[0]] * 12)), (2, pair[1]), (3, " ".join(pair[1])[:600])]
    got = decontaminate.scan(spark, docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == brute_overlap(rows, items)


def test_sums_tell_spans_apart():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 3, 3000).astype(np.uint64)
    sums = bt.Sums(values)
    start = rng.integers(0, 2900, 4000)
    end = start + rng.integers(0, 9, 4000)
    made = {}
    for s, e, h in zip(start.tolist(), end.tolist(), sums.spans(start, end).tolist(), strict=True):
        assert made.setdefault((tuple(values[s:e]), e - s), h) == h
    at = start + rng.integers(0, 9, 4000)
    longer = at + 1 + rng.integers(0, 9, 4000)
    less = bt.Sums(np.concatenate([np.concatenate([values[s:a], values[a + 1 : e]]) for s, a, e in zip(start, at, longer, strict=True)]))
    size = np.cumsum(np.concatenate([[0], longer - start - 1]))
    assert (sums.without(start, at, longer) == less.spans(size[:-1], size[1:])).all()


def test_clashing_result_columns(spark, docs):
    table = docs([(1, "one line\none line"), (2, "one line")]).selectExpr("*", "doc_id as __lines", "text as __removed")
    out = linededup.dedup_lines(spark, table)
    assert out.columns == [*table.columns, "__lines_", "__removed_"]
    assert sorted((r["__lines"], r["__lines_"], r["__removed_"]) for r in out.collect()) == [(1, 2, 1), (2, 1, 1)]
