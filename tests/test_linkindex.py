"""The kept links equal a resolution of everything after every change."""

import random

from loomnote.operators import links
from loomnote.operators.linkindex import LinkIndex

NOTE = "path string, text string"
PATHS = ["a.md", "A.md", "x/a.md", "x/b.md", "b.md", "y/c.md", "c", "x/y/d.md", "z/D.md", "e.txt"]
TARGETS = ["a", "A", "x/a", "x/a.md", "b", "c", "c#head", "y/c|alias", "d", "D", "e.txt", "e", "none"]


def rows(frame):
    return sorted((r.src, r.pos, r.target, r.resolved) for r in frame.collect())


def test_random_changes_equal_a_resolution_of_everything(spark, tmp_path):
    rnd = random.Random(7)
    index, now = LinkIndex(spark, str(tmp_path / "links")), {}
    for batch in range(12):
        changed = {p: " ".join(f"[[{rnd.choice(TARGETS)}]]" for _ in range(rnd.randrange(4))) for p in rnd.sample(PATHS, rnd.randrange(4))}
        removed = {p for p in PATHS if rnd.random() < 0.2}
        if batch % 3 == 0 and now:  # a rename
            old, new = rnd.choice(sorted(now)), rnd.choice(PATHS)
            changed[new] = now[old]
            removed.add(old)
        for p in removed - set(changed):
            now.pop(p, None)
        now.update(changed)
        gen = index.apply(spark.createDataFrame(sorted(changed.items()), NOTE), spark.createDataFrame([(p,) for p in sorted(removed)], "path string"))
        if batch % 4 == 3:
            index.compact()
        notes = spark.createDataFrame(sorted(now.items()), NOTE)
        assert rows(index.links()) == rows(links.resolve(links.extract(notes), notes)), batch
        assert {r.path for r in index.paths().collect()} == set(now)
        if batch == 5:
            assert index.apply(spark.createDataFrame([("a.md", "")], NOTE), None, gen) == gen  # done already


def test_only_what_a_change_can_touch_is_resolved_again(spark, tmp_path):
    index = LinkIndex(spark, str(tmp_path / "links"))
    index.apply(spark.createDataFrame([(f"n{i}.md", f"[[n{i + 1}]] [[twin]]") for i in range(50)] + [("x/twin.md", "")], NOTE))
    index.apply(spark.createDataFrame([("new.md", "[[n7]]")], NOTE))
    assert {r.src for r in index._own("sources", 1).collect()} == {"new.md"}
    index.apply(spark.createDataFrame([("y/n50.md", "")], NOTE))
    assert {r.src for r in index._own("sources", 2).collect()} == {"n49.md", "y/n50.md"}
    index.apply(spark.createDataFrame([("y/twin.md", "")], NOTE))  # now two notes have the name
    assert index.links().where("target = 'twin' and resolved is not null").count() == 0
