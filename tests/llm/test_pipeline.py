"""The pipeline's stages on planted cases, each stage against what it should keep."""

import random

import pytest

import corpus_pipeline
from cases import ODD
from loomnote.llm import minhash


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(11)
    root = tmp_path_factory.mktemp("sf")
    vocabulary = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    bad = ["worthless", "idiotic", "pathetic", "disgusting"]
    rows, labels = [], []
    for i in range(240):
        words = prose(80).split()
        if i % 4 == 0:
            for _ in range(5):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 != 1), int(i % 4 == 0)))
    base = prose(150).split()
    rows += [(1000, "\n".join(" ".join(base[k : k + 30]) for k in range(0, 150, 30))), (1001, " ".join(base[:75]) + " changed " + " ".join(base[75:]))]
    item = prose(40)
    rows += [(2000, prose(30) + " " + item + " " + prose(30)), (3000, None), (3001, ""), (3002, rows[1][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_in_turn(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables).cache()
        assert out.columns == columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        gone = before - kept
        if name == "toxicity":
            assert len([i for i in gone if i < 240 and i % 4 == 0]) >= 55
            assert len([i for i in gone if i >= 1000 or i % 4]) <= 3
        elif name == "line dedup":
            assert not gone and out.where("doc_id = 3002").first().text == "" and out.where("n_chars <> length(text)").count() == 0
        elif name == "near dedup":
            assert gone == {1001}
        else:
            assert gone == {2000}
        docs, before = out, kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert last.count() == len(before) and last.where("n_bytes > 0 and n_tokens = 0").count() == 0
    assert corpus_pipeline.run(spark, tables).count() == len(before)


def test_stages_take_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0
    assert minhash.near_duplicates(spark, docs).count() == 0


def test_stages_take_odd_rows(spark, tables, docs):
    """Null and repeated ids, very long and empty texts, clashing columns: none crashes a stage or loses an id-less row."""
    far = [(i if i is None else i + 5000, t) for i, t in ODD]  # ids without labels
    base = docs([*far, *((i, f"line {i} of a clean text\nwith words like number{i}") for i in range(5020, 5060)), (None, None), (5009, None), (5009, None)])
    names, out = base.columns, base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, tables)
        assert out.columns == names, name
    rows = out.select("doc_id", "text").collect()
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 5009 for r in rows) == 2 and {r.doc_id for r in rows} >= {5001, 5002, 5003, 5004, 5007}
    last = corpus_pipeline.STAGES[-1][1](spark, out, tables).collect()
    assert len(last) == len(rows)
