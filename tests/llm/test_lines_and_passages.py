"""Line and passage removal equal plain dictionaries of all that came before."""

import random

from cases import ODD

from loomnote.llm import linededup, passages


def key(i):
    return (i is None, i)


def brute_lines(rows):
    """Rows have distinct ids; returns each text without lines that an earlier one is near to."""
    equal, changed, shorter, out = set(), set(), set(), {}
    for i, text in sorted(rows):
        kept = []
        for line in (text or "").split("\n"):
            if len(line) < linededup.MIN_CHARS:
                kept.append(line)
                continue
            holes = {(line[:k], line[k + 1 :]) for k in range(len(line))}
            less = {line[:k] + line[k + 1 :] for k in range(len(line))}
            if not (line in equal or line in shorter or holes & changed or less & equal):
                kept.append(line)
            equal.add(line)
            changed |= holes
            shorter |= less
        out[i] = None if text is None else "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark, docs):
    rnd = random.Random(6)
    lines = ["".join(rnd.choice("abcé ") for _ in range(rnd.randrange(20, 90))) for _ in range(30)]

    def edited(line):
        for _ in range(rnd.choice([0, 1, 1, 2])):
            p = rnd.randrange(len(line))
            line = rnd.choice([line[:p] + line[p + 1 :], line[:p] + "z" + line[p:], line[:p] + "y" + line[p + 1 :]])
        return line

    rows = [(i, "\n".join(edited(rnd.choice(lines)) for _ in range(rnd.randrange(0, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 5000), (104, "x" * 5001 + "\n" + "x" * 5003), (105, "short\nshort")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark, docs(rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_of_odd_rows(spark, docs):
    table = docs(ODD + [(None, "a line that repeats and is long enough\na line that repeats and is long enough")])
    out = linededup.dedup_lines(spark, table)
    assert out.count() == len(ODD) + 1 and out.columns == [*table.columns, "__lines", "__removed"]
    assert out.where("doc_id is null and __removed > 0").count() == 0
    assert linededup.dedup_lines(spark, docs([])).count() == 0


def brute_all_lines(rows):
    """As brute_lines, but every line counts that is not blank, however short."""
    before, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            if not line.strip() or not any(near(line, other) for other in before):
                kept.append(line)
            if line.strip():
                before.append(line)
        out[i] = "\n".join(kept)
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_lines_of_any_length_equal_brute_force(spark, docs):
    rnd = random.Random(16)
    made = lambda n: "".join(rnd.choice("abcdefghé中") for _ in range(n))
    lines = [made(n) for n in range(1, 36) for _ in range(3)]

    def edited(line):
        for _ in range(rnd.choice([0, 1, 1, 2])):
            p = rnd.randrange(len(line) + 1)
            line = rnd.choice([line[:p] + line[p + 1 :], line[:p] + "z" + line[p:], line[:p] + "y" + line[p + 1 :]])
        return line

    rows = [(i, "\n".join(edited(rnd.choice(lines)) for _ in range(rnd.randrange(0, 8)))) for i in range(120)]
    rows += [(200, "All rights reserved.\n\n \t\n\u3000\n"), (201, "All rights reserved.\n\n \t\n\u3000\nAll rights reserved"), (202, "\u2028\nx\u3000y z q w e r t\nx\u3000y z q w e r")]
    # pairs on both sides of every bound between units
    for n in range(1, 60):
        line, p = made(n + 1), rnd.randrange(n + 1)
        rows.append((300 + n, f"{line}\n{line[:p]}{line[p + 1 :]}"))
    rnd.shuffle(rows)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark, docs(rows)).collect()}
    assert got == brute_all_lines(rows)


def brute_passages(rows):
    source = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - 12) if i is not None else []:
            x = tuple(w[k : k + 13])
            source[x] = min(i, source.get(x, i))
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12) if i is not None else []:
            if source[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), b" ".join(a for a, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=lambda r: (key(r[0]), r[3]))


def test_passages_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(passages, "SHARD_BYTES", 4000)
    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "b", "cc", "É", "d."])
    shared = [[word() for _ in range(rnd.randrange(8, 60))] for _ in range(15)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rnd.randrange(0, 4)):
            text += [f"u{rnd.randrange(9)}" for _ in range(rnd.randrange(0, 10))]
            p = rnd.choice(shared)
            a = rnd.randrange(len(p))
            text += p[a : a + rnd.randrange(5, 40)]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(text)))
    rows += [(200, "rest " * 300), (201, "rest " * 100), (202, "x " + "rest " * 13)] + [(300 + n, t) for n, (_, t) in enumerate(ODD)] + [(None, "rest " * 50), (201, "rest " * 40)]
    got = passages.remove_repeats(spark, docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=lambda r: (key(r[0]), r[3])) == brute_passages(rows)
    assert passages.remove_repeats(spark, docs([])).count() == 0
