"""Overlap equals a dictionary of windows, with benchmark blocks of any size."""

import random
import re

from cases import ODD

from loomnote.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(documents, items):
    windows = {}
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)) if w and name is not None else []:
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(name))
    out = []
    for i, text in documents:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(2)
    vocabulary = "a b c Dé e1 f-g".split()
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([1, 2, 9, 10, 14, 40]))) for i in range(25)] + [(90, None), (91, ""), (None, text(20)), (92, "é!É  x")]
    documents = [(i, text(rnd.randrange(0, 80))) for i in range(60)]
    for i in range(60, 90):
        a = rnd.choice(items[:25])[1]
        documents.append((i, text(5) + ", " + a.upper() + "! " + text(5)))
    return documents + ODD, items


def test_equals_brute_force(spark, docs):
    documents, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 60):
        got = decontaminate.scan(spark, docs(documents), benchmark, block_words=block)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()), key=str) == brute(documents, items)


def test_matches_are_the_longest(spark, docs):
    item = " ".join(f"w{i}" for i in range(30))
    documents = [(1, "x " + " ".join(item.split()[3:20]) + " y"), (2, item + " " + item)]
    benchmark = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = {(r.doc_id, r.doc_word, r.item_word, r.n_words) for r in decontaminate.matches(spark, docs(documents), benchmark).collect()}
    assert got == {(1, 1, 3, 17), (2, 0, 0, 30), (2, 30, 0, 30)}


def test_empty_tables(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(spark, docs([(1, "a b")]), nothing).first().n_hit == 0
    assert decontaminate.matches(spark, docs([(1, "a b")]), nothing).count() == 0
    assert decontaminate.scan(spark, docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_removal_keeps_columns(spark, docs):
    item = " ".join(f"w{i}" for i in range(12))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    table = docs([(1, item), (2, "clean"), (None, "no id"), (3, None)])
    left = decontaminate.remove_contaminated(spark, table, benchmark)
    assert left.columns == table.columns and sorted(map(str, (r.doc_id for r in left.collect()))) == ["2", "3", "None"]


def test_periodic_texts_and_matches_by_brute_force(spark, docs, monkeypatch):
    rnd = random.Random(8)
    items = [(1, "a b " * 40), (2, "a b a"), (3, " ".join(rnd.choice("ab") for _ in range(60)))]
    documents = [(1, "a b " * 300), (2, "b " + "a b " * 20), (2, "a b a"), (None, " ".join(rnd.choice("ab") for _ in range(200))), (3, None), (4, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "PAIRS", 100)
    got = decontaminate.scan(spark, docs(documents), benchmark)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()), key=str) == brute(documents, items)
    want = []
    for i, text in documents:
        d = words(text)
        for name, item in items:
            w = words(item)
            for p in range(len(d)):
                for q in range(len(w)):
                    if p and q and d[p - 1] == w[q - 1]:
                        continue
                    n = 0
                    while p + n < len(d) and q + n < len(w) and d[p + n] == w[q + n]:
                        n += 1
                    if n >= min(10, len(w)):
                        want.append((i, str(name), p, q, n))
    found = [(r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in decontaminate.matches(spark, docs(documents), benchmark).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
