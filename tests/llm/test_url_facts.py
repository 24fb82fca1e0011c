"""A URL's facts are all mined, whatever their number."""

from loomnote.llm import urlfilter


def test_a_rule_of_facts_that_go_with_block_the_least_is_found(spark):
    rows, decoys = [], [f"d{j}" for j in range(11)]
    for i in range(120):
        rows.append((f"http://x{i}.test/a/b/" + "/".join(d for j, d in enumerate(decoys) if (i + 7 * j) % 12), True))
    for i in range(70):
        rows.append((f"http://a{i}.test/a/c{i}", False))
        rows.append((f"http://b{i}.test/b/e{i}", False))
    for i in range(40):  # each decoy alone goes with `block` more often than a or b
        rows.append((f"http://e{i}.test/{decoys[i % 11]}", False))
    frame = spark.createDataFrame(rows, "url string, block boolean")
    found = {tuple(items): (c, round(s, 9)) for items, c, s in urlfilter.mine(frame, min_lift=1.2)}
    assert found[("p:a", "p:b")] == (1.0, round(120 / 300, 9))


def test_a_fact_that_never_fails_is_one_rule(spark):
    rows = [(f"http://x{i}.test/bad/s{i % 3}", True) for i in range(60)] + [(f"http://y{i}.test/good/s{i % 3}", False) for i in range(60)]
    assert urlfilter.mine(spark.createDataFrame(rows, "url string, block boolean")) == [(["p:bad"], 1.0, 0.5)]
