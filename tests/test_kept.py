"""The kept index equals a search over all texts, whatever changes made it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomnote.functions import text as T
from loomnote.operators import kept, search

SCHEMA = "path string, chunk_id string, text string, heading string"
WORDS = ["cat", "cats", "dog", "The", "of", "a1", "é", "cut", "cart", "act", "scat"]


def chunk(rnd, path, n):
    return (path, f"{path}#{n}", " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 12))) or None, rnd.choice([None, "", "one head", "cat of two"]))


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_random_changes_equal_a_search_over_everything(spark, tmp_path):
    rnd = random.Random(5)
    index, now, terms = kept.KeptIndex(spark, str(tmp_path / "index"), buckets=3), {}, [(1, ["cat", "the"]), (2, ["é", "of", "none"]), (3, [])]
    queries = spark.createDataFrame(terms, "query_id long, terms array<string>")
    for batch in range(8):
        changed = {f"p{rnd.randrange(12)}" for _ in range(4)}
        removed = {p for p in now if rnd.random() < 0.15} - changed
        made = [chunk(rnd, p, n) for p in changed for n in range(rnd.randrange(1, 4))]
        for p in changed | removed:
            now.pop(p, None)
        for c in made:
            now.setdefault(c[0], []).append(c)
        before = index.apply(spark.createDataFrame(made, SCHEMA), spark.createDataFrame([(p,) for p in removed], "path string"))
        assert index.apply(spark.createDataFrame(made, SCHEMA), None, before) == before  # a batch that runs twice
        if batch == 5:
            index.compact()
            assert len(index.generations()) == 1
        if batch in (1, 5, 7):
            whole = spark.createDataFrame([c for cs in now.values() for c in cs], SCHEMA)
            want = search.bm25(whole, queries, ("text", "heading"), 5)
            assert rows(index.bm25(queries, k=5), "query_id", "rank", "chunk_id", "score") == rows(want, "query_id", "rank", "chunk_id", "score")
    for text in ('"cat of"~2 dog', "cat~ -the", "+heading:cat [ca TO cz]", '"the cat"^2 a1', "/c.t/ AND (of OR é)", "ca*", "*", "-dog", "don't"):
        want = search.scored_syntax(whole, text)
        assert rows(index.search(text), "chunk_id", "score") == rows(want, "chunk_id", "score"), text


def test_a_search_reads_its_terms_folders_alone(spark, tmp_path):
    made = spark.range(200).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("word"), "id", F.lit(" shared")).alias("text"), F.lit("").alias("heading"))
    index = kept.index_of(spark, str(tmp_path / "index"), made)
    one = index.postings(["word7"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "PushedFilters" in plan and "term" in plan.split("PushedFilters")[1].split("]")[0]
    assert one.count() == 1
    prefix = index.expand({"kind": "prefix", "text": "word19"})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,word19)" in prefix


def test_words_within_two_edits(spark, tmp_path):
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(400)})
    index = kept.index_of(spark, str(tmp_path / "index"), spark.createDataFrame([("p", "c", " ".join(words), None)], SCHEMA))
    for word in ("a", "ab", "abc", "abca", "abcabc", "cbacbacb", "zzz"):
        got = {r.term for r in index.expand({"kind": "fuzzy", "text": word}).collect()}
        table = spark.createDataFrame([(w,) for w in words], "w string")
        assert got == {r.w for r in table.where(F.levenshtein("w", F.lit(word)) <= 2).collect()}, word


def nearest(words, tokens, slop):
    """The shortest stretches that hold a place of each word, by trying all."""
    places = [[i - s for i, t in enumerate(tokens) if t == w] for s, w in enumerate(words)]
    ends = {(a, b) for a in sum(places, []) for b in sum(places, []) if a <= b and all(any(a <= p <= b for p in own) for own in places)}
    least = [(a, b) for a, b in ends if not any((c, d) != (a, b) and a <= c and d <= b for c, d in ends)]
    return sum(1 / (1 + b - a) for a, b in least if b - a <= slop)


@pytest.mark.parametrize("words", [["a", "b"], ["a", "b", "c"], ["c", "a", "b"]])
def test_sloppy_frequency(spark, words):
    rnd = random.Random(3)
    texts = [[rnd.choice("abcd") for _ in range(rnd.randrange(0, 14))] for _ in range(80)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    for slop in (0, 1, 4):
        got = {r.i: r.f for r in table.select("i", search.phrase_frequency(F.col("t"), words, slop).alias("f")).collect()}
        assert all(math.isclose(got[i], nearest(words, t, slop)) for i, t in enumerate(texts))


def test_slop_in_the_syntax(spark):
    assert search.parse_query('"a b"~3^2')[0] == {"kind": "phrase", "field": None, "text": "a b", "boost": 2.0, "occur": "should", "slop": 3}
    table = spark.createDataFrame([("x", "c1", "a x x b", None), ("x", "c2", "a b", None), ("x", "c3", "b a", None)], SCHEMA)
    for text, want in (('"a b"', {"c2"}), ('"a b"~2', {"c1", "c2", "c3"}), ('"a b"~1', {"c2"})):
        assert {r.chunk_id for r in search.matching(table, text).collect()} == want
    assert T.words(F.lit("x")) is not None


def test_empty_index(spark, tmp_path):
    index = kept.KeptIndex(spark, str(tmp_path / "index"))
    assert index.search("anything").count() == 0 and index.generations() == []
    index.apply(spark.createDataFrame([], SCHEMA))
    assert index.search("any* -thing").count() == 0 and index.bm25(spark.createDataFrame([(1, ["x"])], "query_id long, terms array<string>")).count() == 0
