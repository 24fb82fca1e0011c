"""A vault through its whole life."""

import pytest

from loomnote.operators.filters import Filters
from loomnote.vault import Vault


@pytest.fixture(scope="module")
def vault(spark):
    rows = [("a.md", "---\ntags: [x]\ntype: policy\n---\n# Alpha\nthe cat sat [[b]]"), ("n/b.md", "# Beta\nthe dog ran"), ("messy/d.md", "a draft about cats"), ("p.md", "---\nprivate: true\n---\nhidden cat")]
    return Vault.of_notes(spark.createDataFrame(rows, "path string, text string"), epoch=100)


def test_read_and_search(vault):
    assert [r.path for r in vault.list().collect()] == ["a.md", "messy/d.md", "n/b.md", "p.md"]
    assert {r.path for r in vault.search("cat", "KEYWORD").collect()} == {"a.md"}
    assert {r.path for r in vault.search("cat*", "KEYWORD", given=Filters(include_drafts=True)).collect()} == {"a.md", "messy/d.md"}
    assert {r.path for r in vault.search("", given=Filters(tags=["x"])).collect()} == {"a.md"}
    assert vault.search("").count() == 0
    assert [r.path for r in vault.grep("cat", literal=True).collect()] == ["a.md"]
    assert [(r.target, r.resolved) for r in vault.link("a.md").collect()] == [("b", "n/b.md")]
    assert {(r.path, r.way) for r in vault.graph_query("n/b.md").collect()} == {("a.md", "in")}


def test_packs(vault):
    rows = vault.context_pack("cat", expand=True).collect()
    assert [(r.path, r.via) for r in rows] == [("a.md", None), ("n/b.md", "a.md")] and rows[0].author == "import"
    assert {r.path for r in vault.context_pack(given=Filters(type="policy"), enumerate=True).collect()} == {"a.md"}
    with pytest.raises(ValueError):
        vault.context_pack("cat", expand=True, as_of=100)


def test_writes(vault):
    out, same = vault.write("a.md", "new")
    assert out.status == "conflict" and same is vault
    out, v2 = vault.write("a.md", "now about birds", out.revision, epoch=200)
    assert out.status == "ok" and v2.read("a.md").first().text == "now about birds"
    assert {r.path for r in v2.search("cat", "KEYWORD", as_of=150).collect()} == {"a.md"}
    assert vault.write("../x.md", "t")[0].status == "bad_request"
    assert vault.write("s.md", "password = hunter2hunter2")[0].status == "blocked"
    out, v3 = v2.edit("a.md", "birds", "fish", epoch=300)
    assert out.status == "ok" and "fish" in v3.read("a.md").first().text
    assert v2.edit("a.md", "nothing", "x")[0].status == "bad_request"
    old, new = (r.revision for r in v3.changes.where("path = 'a.md' and seq > 1").orderBy("seq").collect())
    assert "-now about birds" in v3.diff("a.md", old, new).first()["diff"]
    assert [r.seq for r in v3.history("a.md").orderBy("place").collect()] == [3, 2, 1]


def test_moves_and_trash(vault):
    out, v2 = vault.move("n/b.md", "n/c.md", epoch=200)
    assert out.status == "ok" and "[[c]]" in v2.read("a.md").first().text
    assert {r.path for r in v2.list().collect()} == {"a.md", "messy/d.md", "n/c.md", "p.md"}
    out, v3 = v2.delete("n/c.md", epoch=300)
    assert [(r.origin, r.trash_path) for r in v3.trash().collect()] == [("n/c.md", ".trash/n/c.md")] and v3.read("n/c.md").first() is None
    assert vault.promote("a.md", "b.md")[0].status == "bad_request"
    assert vault.promote("messy/d.md", "d.md")[0].status == "ok"


def test_memories(vault):
    out, v2 = vault.remember("The user likes green tea", epoch=200)
    assert (out.status, out.detail) == ("ok", "new")
    assert v2.remember("The user likes green tea")[0].detail == "duplicate"
    assert v2.remember("the user LIKES green tea!")[0].detail.startswith("duplicate of memory/fact/")
    assert v2.extract_memories("x")[0].status == "not_configured"
    out, v3 = v2.extract_memories("x", lambda t: ["one entirely different thing"])
    assert out.detail == "1" and v3.list("memory/").count() == 2


def test_private_notes_stay_out_of_the_graph(spark):
    rows = [("a.md", "[[b]] [[secret]]"), ("b.md", "text"), ("secret.md", "---\nprivate: true\n---\n[[a]] [[b]]")]
    vault = Vault.of_notes(spark.createDataFrame(rows, "path string, text string"))
    assert {(r.a, r.b) for r in vault.graph_edges().collect()} == {("a.md", "b.md")}
    assert "secret.md" not in {r.node for r in vault.graph_communities().collect()} and "secret.md" not in {r.community for r in vault.graph_communities().collect()}
    assert {r.path for r in vault.context_pack(enumerate=True).collect()} == {"a.md", "b.md"}
    assert {r.path for r in vault.graph_query("a.md").collect()} == {"b.md"} and vault.graph_query("secret.md").count() == 0


def test_restore_purge_and_bytes(spark):
    vault = Vault.of_notes(spark.createDataFrame([("a.md", "alpha"), ("b.md", "beta")], "path string, text string"))
    _, gone = vault.delete("a.md")
    out, back = gone.restore(".trash/a.md")
    assert (out.status, out.detail) == ("ok", "a.md") and back.read("a.md").first().text == "alpha" and gone.read("a.md").first() is None
    assert gone.write("a.md", "new")[1].restore(".trash/a.md")[0].status == "conflict" and vault.restore(".trash/a.md")[0].status == "not_found"
    assert gone.purge(".trash/a.md", "0" * 40)[0].status == "conflict" and gone.purge("b.md")[0].status == "bad_request"
    out, empty = gone.purge(".trash/a.md")
    assert out.status == "ok" and empty.restore(".trash/a.md")[0].status == "not_found"
    out, more = vault.write_bytes("c.md", "é".encode())
    assert out.status == "ok" and more.read("c.md").first().text == "é"
    assert vault.write_bytes("c.md", b"\xff")[0].status == "bad_request" and more.write_bytes("c.md", b"x")[0].status == "conflict"


def test_syntax_search_scores_and_degrades(spark):
    rows = [("a.md", "cats and dogs"), ("b.md", "cats cats"), ("c.md", "birds")]
    vault = Vault.of_notes(spark.createDataFrame(rows, "path string, text string"))
    got = [r.path for r in vault.search("cats (dogs OR birds)^9", "KEYWORD").orderBy("rank").collect()]
    assert got[-1] == "b.md" and set(got) == {"a.md", "b.md", "c.md"}
    assert {r.path for r in vault.search("[ca TO cz] -dogs", "KEYWORD").collect()} == {"b.md"}
    assert {r.degraded for r in vault.search("cats", "HYBRID").collect()} == {False}
    vectors = vault.chunks.select("content_hash").withColumn("vec", __import__("pyspark").sql.functions.array(*map(__import__("pyspark").sql.functions.lit, [1.0, 0.0])))
    held = Vault(spark, vault.changes, vectors)
    assert {r.degraded for r in held.search("cats", "HYBRID").collect()} == {True}
    assert {r.degraded for r in held.search("cats*", "HYBRID", vector=[1.0, 0.0]).collect()} == {False}
    assert "**cats**" in held.search("cats", "KEYWORD").first().snippet
    assert {r.path for r in held.context_pack("birds", vector=[1.0, 0.0]).collect()} == {"a.md", "b.md", "c.md"}


def test_remember_supersedes_and_adjudicates(spark):
    vault = Vault.of_notes(spark.createDataFrame([("m/tea.md", "---\ntype: fact\nstatus: active\n---\nthe team drinks green tea every morning")], "path string, text string"))
    out, after = vault.remember("the team drinks black coffee now", supersedes="m/tea.md")
    old = after.parsed.where("path = 'm/tea.md'").first()
    assert out.detail == "update" and old.status == "revoked" and after.read(old.superseded_by).first() is not None
    assert vault.remember("x y z", supersedes="none.md")[0].status == "not_found"
    close = "the team drinks green tea every evening"
    assert vault.remember(close)[0].detail == "uncertain"
    out, after = vault.remember(close, adjudicate=lambda a, b: "CONTRADICTION")
    made = after.parsed.where("contradicts is not null").first()
    assert out.detail == "contradiction" and made.contradicts == "m/tea.md" and made.needs_review
    assert vault.remember(close, adjudicate=lambda a, b: "DUPLICATE")[0].detail == "duplicate of m/tea.md"


def test_graph_status_and_chunked_import(spark):
    vault = Vault.of_notes(spark.createDataFrame([(f"n{i}.md", f"# T\n[[n{(i + 1) % 4}]]") for i in range(4)], "path string, text string"), per_commit=3)
    assert sorted(r.seq for r in vault.changes.collect()) == [1, 1, 1, 2]
    row = vault.graph_status().first()
    assert (row.nodes, row.links, row.with_vector) == (4, 4, 0)
    home = vault.graph_communities().where("level = 0 and node = 'n1.md'").first().community
    assert "n1.md" in {r.path for r in vault.graph_community(home).collect()}
