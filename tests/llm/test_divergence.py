"""Values and ranks equal a plain sum over all terms and pairs, however the terms are split."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import ODD

from loomnote.llm import divergence

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, g long, term string, value double"


def brute(rows, top=200):
    words, holders = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = Counter(x.decode() for x in TERM.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())))
        groups[lang].add(source)
        words[lang, source].update(found)
        holders[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in holders[lang].items() if n >= 3}
        every = Counter()
        for s in sources:
            every.update({t: n for t, n in words[lang, s].items() if t in kept})

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        p, q = {s: shares(words[lang, s]) for s in sources}, shares(every)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if words[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def table(spark, rows, parts=3):
    made = [(i, *row, i, "x", 0.5) for i, row in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(parts)


def result(spark, rows, **how):
    return sorted(tuple(r) for r in divergence.audit(spark, table(spark, rows), **how).collect())


def corpus(seed, sources, texts):
    rnd = random.Random(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["É", "é", "中文", "ß"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for _ in range(texts):
        s = rnd.randrange(sources)
        own = rnd.choices(vocabulary, weight, k=rnd.randrange(0, 40)) + [f"only{chr(97 + s)}"] * rnd.randrange(3)
        rows.append((rnd.choice([" ", "1", ". "]).join(w.upper() if rnd.random() < 0.2 else w for w in own), rnd.choice(["en", "fr", None]), f"s{s}" if s else None))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"TILE_TERMS": 7, "TILE_GROUPS": 3, "UNIT_COUNTS": 5, "FEW_GROUPS": 0}, {"MOST_POSTINGS": 1}, {"MOST_POSTINGS": 0}])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(3, 8, 150) + [(None, "en", "none"), ("", "xx", None), ("one lonely text", "xx", "b"), ("123 !", "yy", "only")]
    assert result(spark, rows) == brute(rows)


def test_odd_rows_repeats_and_ties(spark):
    rows: list = [(t, "en", "a" if k % 2 else "b") for k, (_, t) in enumerate(ODD)] * 2 + [("same words here", "en", s) for s in "abcabc"]
    assert result(spark, rows, top_terms=3) == brute(rows, 3)


def test_empty_table_and_single_group(spark):
    assert result(spark, []) == []
    assert result(spark, [("a b a", "en", "s")] * 4) == brute([("a b a", "en", "s")] * 4)


def test_shares_are_exact_for_large_counts():
    counts, total = np.array([0, 9 * 10**14, 12345678901234, 10**15 - 1]), np.array([10**15, 10**15 + 7, 3 * 10**14, 10**15])
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts.tolist(), total.tolist(), strict=True)]
