"""Sets that overlap by much are found by equal parts: few candidates, and no pair is lost."""

import itertools
import random

import pytest

from loomnote.operators import memory
from loomnote.plans import views as V


def brute(notes, minimum):
    found = []
    for (p, k, t), (q, l, u) in itertools.combinations(notes, 2):
        a, b = set((t or "").split()), set((u or "").split())
        if p and q and p != q and k and k == l and a and b and min(len(a), len(b)) >= minimum * max(len(a), len(b)) and round(len(a & b) / len(a | b), 6) >= minimum:
            found.append((min(p, q), max(p, q), round(len(a & b) / len(a | b), 6)))
    return sorted(found)


def changed(rnd, words, vocabulary):
    out = list(words)
    for _ in range(rnd.randrange(0, max(2, len(out) // 7))):
        turn = rnd.random()
        if turn < 0.4 and len(out) > 1:
            out.pop(rnd.randrange(len(out)))
        elif turn < 0.7:
            out.append(rnd.choice(vocabulary))
        else:
            out[rnd.randrange(len(out))] = rnd.choice(vocabulary)
    return rnd.sample(out, len(out))


def test_common_words_make_few_candidates(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(rnd.sample(words, 60)) for _ in range(400)]
    texts += [" ".join([*t.split()[:59], f"x{i}"]) for i, t in enumerate(texts[:10])]
    notes = [(f"n{i}", "fact", t) for i, t in enumerate(texts)]
    sizes, keep = [], memory.cut
    monkeypatch.setattr(memory, "cut", lambda rows: (lambda out: (sizes.append((out.columns, out.count())), out)[1])(keep(rows)))
    got = memory.near_words(spark.createDataFrame(notes, "path string, type string, text string"), 0.9).collect()
    assert sorted(map(tuple, got)) == brute(notes, 0.9) and len(got) == 10
    assert max(n for c, n in sizes if {"a", "b"} <= set(c)) < 200  # of 83,845 pairs


@pytest.mark.parametrize(("minimum", "asked", "at_once"), [(0.9, 10**6, 10**6), (0.85, 0, 10**6), (0.97, 10**6, 50), (1.0, 10**6, 10**6)])
def test_near_sets_of_all_sizes_equal_brute_force(spark, monkeypatch, minimum, asked, at_once):
    monkeypatch.setattr(memory, "ASKED", asked)
    monkeypatch.setattr(memory, "PART_WORDS", at_once)
    rnd = random.Random(int(minimum * 100))
    words = [f"w{i}" for i in range(400)]
    bases = [rnd.sample(words, n) for n in (*range(1, 24), 40, 57, 90, 130, 200, 300)]
    texts = [" ".join(changed(rnd, b, words)) for b in bases for _ in range(10)]
    texts += [" ".join(words[:9]), " ".join(words[:10]), " ".join(words[:19]), " ".join([*words[1:19], "other"])]  # 0.9 exactly
    notes = [(f"n{i}", ("fact", "policy", "fact a")[i % 3 if i % 5 else 0], t) for i, t in enumerate(texts)]
    notes += [("e", "fact", ""), ("f", "fact", None), ("g", "fact", "..."), ("z", None, texts[0]), (None, "fact", texts[0]), ("n3", "fact", texts[7]), *notes[100:200:9]]  # paths twice, with another text and with the same
    got = memory.near_words(spark.createDataFrame(notes, "path string, type string, text string"), minimum).collect()
    assert sorted(map(tuple, got)) == brute([(p, k, t if t != "..." else "") for p, k, t in notes], minimum)


def test_texts_are_notes_with_and_without_several_labels(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"src{i % 2}", 2) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for labels in ([(1, 1, 0), (4, 0, 1)], [(1, 1, 0), (1, 0, 0), (4, 0, 1), (None, 1, 1), (None, 1, 1)]):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        want = V.notes(spark, str(tmp_path)).select("path", "type", "text").collect()
        assert sorted(V.texts(spark, str(tmp_path)).collect()) == sorted(want) and len(want) == (9 if len(labels) == 2 else 10)
