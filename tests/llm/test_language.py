"""Scores equal a model in plain dictionaries; probabilities of all words add up to one."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from cases import ODD

from loomnote.llm import language
from loomnote.llm.shared import Tables


def split(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())), "end"]


class Plain:
    def __init__(self, texts, order):
        self.order, self.plain = order, Counter()
        top = Counter()
        for text in texts:
            w = split(text)
            self.plain.update(w)
            w = ["begin"] * (order - 1) + w
            top.update(tuple(w[i - order + 1 : i + 1]) for i in range(order - 1, len(w)))
        self.grams = {order: top}
        for k in range(order - 1, 0, -1):
            self.grams[k] = Counter(g[1:] for g in self.grams[k + 1])
        self.discounts, self.follow = {}, {}
        for k, grams in self.grams.items():
            of = Counter(grams.values())
            self.discounts[k] = language.discounts(of[1], of[2], of[3], of[4])
            self.follow[k] = defaultdict(list)
            for g, n in grams.items():
                self.follow[k][g[:-1]].append(n)

    def probability(self, gram):
        k = len(gram)
        lower = self.probability(gram[1:]) if k > 1 else 1 / (len(self.plain) + 1)
        counts = self.follow[k].get(gram[:-1])
        if not counts:
            return lower
        d = (0, *self.discounts[k])
        n = self.grams[k][gram]
        left = sum(d[min(c, 3)] for c in counts)
        return (n - d[min(n, 3)] + left * lower) / sum(counts)

    def score(self, text):
        w = split(text)
        n = sum(self.plain.values())
        base = sum(math.log10((self.plain[x] + 1) / (n + len(self.plain) + 1)) for x in w)
        known = sum(self.plain[x] > 0 for x in w)
        w = ["begin"] * (self.order - 1) + w
        p = sum(math.log10(self.probability(tuple(w[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(w)))
        return len(w) - self.order + 1, known, n, round(base, 6), round(p, 6)


def corpus(seed, texts):
    rnd = random.Random(seed)
    words = ["The", "a", "é", "中", "x.", *(f"w{i}" for i in range(60))]
    return [(i, rnd.choice([" ", "\n", " \t "]).join(rnd.choices(words, [1 / (k + 1) for k in range(len(words))], k=rnd.randrange(0, 40)))) for i in range(texts)]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_a_plain_model(spark, docs, order, monkeypatch):
    monkeypatch.setattr(language, "SHARD_ENTRIES", 300)
    rows = corpus(order, 150) + [(1000 + k, t) for k, (_, t) in enumerate(ODD) if k != 4] + [(None, "no id"), (5, "again the same id")]
    learned = [t for i, t in rows if i is not None and crc32(str(i).encode()) % 7 != 2]
    plain = Plain(learned, order)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in language.assess(spark, docs(rows), order).collect()]
    want = [(i, i is None or crc32(str(i).encode()) % 7 == 2, *plain.score(t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark, docs):
    assert language.assess(spark, docs([])).count() == 0
    tables = Tables(spark)
    model = language.train(spark, docs([]), tables)
    got = language.score(spark, docs([(1, "two words"), (2, None)]), model, tables).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.score) for r in got) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]


def test_frequent_grams_and_probabilities_of_all_words(spark, docs):
    texts = ["so it goes " * 400, "it goes on and on", "so on"] * 3
    tables = Tables(spark)
    model = language.train(spark, docs(list(enumerate(texts))), tables)
    plain = Plain(texts, 2)
    got = language.score(spark, docs(list(enumerate(texts))), model, tables).collect()
    assert all(abs(r.score - plain.score(texts[r.doc_id])[-1]) < 1e-5 for r in got)
    for before in ("so", "it", "never-seen"):
        assert abs(sum(plain.probability((before.encode(), w)) for w in [*plain.plain, "unknown"]) - 1) < 1e-9


def test_held_out_texts_are_better_foretold_than_by_single_words(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.assess(spark, table).where("held_out and n_tokens > 1").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b * 0.97


def test_shards_keep_large_counts(tmp_path):
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    counts = rng.choice([0, 1, 254, 255, 256, 1 << 40], (3, len(key)))
    uri = f"file://{tmp_path}/a/b"
    language.Shard.write(uri, key, counts)
    ask = np.sort(np.concatenate([key[::3], key[::5] + np.uint64(1)]))
    want = {int(k): counts[:, i].tolist() for i, k in enumerate(key)}
    assert language.Shard(uri).counts(ask).T.tolist() == [want.get(int(k), [0, 0, 0]) for k in ask]
