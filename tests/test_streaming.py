"""Streams give what the same rows give as a batch."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from loomnote.operators import history
from loomnote.streaming import commits

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def change(seq, path, op="add", new_path=None, revision=None, text="t"):
    return (seq, path, op, new_path, revision or f"r{seq}", text, "u", START)


ROWS = [change(1, "a"), change(2, "b"), change(3, "a", "modify"), change(4, "b", "delete"), change(5, "a", "rename", "c", "r3"), change(6, "d")]


def test_maintained_state_equals_snapshot(spark, tmp_path):
    for i in range(0, len(ROWS), 2):
        spark.createDataFrame(ROWS[i : i + 2], commits.CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = commits.change_stream(spark, str(tmp_path / "in"), 1)
    run = commits.maintain(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = max(int(p.name) for p in (tmp_path / "state").iterdir() if p.name.isdigit())
    state = spark.read.parquet(str(tmp_path / "state" / str(last))).where("not gone")
    want = history.snapshot(spark.createDataFrame(ROWS, commits.CHANGE))
    assert {(r.path, r.revision) for r in state.collect()} == {(r.path, r.revision) for r in want.collect()}


def test_upsert_is_idempotent_and_order_free(spark):
    frame = spark.createDataFrame(ROWS, commits.CHANGE)
    once = commits.upsert(frame, None)
    again = commits.upsert(frame.where("seq <= 3"), once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.select(once.columns).collect()))


def test_token_bucket_keeps_its_level(spark, tmp_path):
    schema = "key string, seq long, epoch double"
    rows = [("k", i, float(i // 3)) for i in range(9)]
    for i in range(0, 9, 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = commits.limited(stream, 4, 1).writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    batch = {r.seq: r.allowed for r in history.token_bucket(spark.createDataFrame(rows, schema), 4, 1).collect()}
    assert {r.seq: r.allowed for r in spark.table("limited").collect()} == batch


def test_sources(spark, tmp_path):
    from loomnote.functions import text as T
    from loomnote.sources import files

    root = tmp_path / "vault"
    (root / "a b").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "a b" / "n+1.md").write_text("hello\n")
    (root / "pic.png").write_bytes(b"\x00\x01")
    (root / ".git" / "x.md").write_text("no")
    (root / ".hidden.md").write_text("no")
    assert {r.path for r in files.vault_files(spark, str(root)).collect()} == {"a b/n+1.md", "pic.png"}
    row = files.vault_notes(spark, str(root)).first()
    assert (row.path, row.text, row.revision) == ("a b/n+1.md", "hello\n", "ce013625030ba8dba906f756967f9e9ca394464a")
    plan = files.import_plan(spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, text string"), spark.createDataFrame([("y", "1"), ("z", "2")], "path string, text string"))
    assert {r.path: r.outcome for r in plan.collect()} == {"x": "imported", "y": "unchanged", "z": "skipped"}
    k = "0123456789abcdef" * 2
    names = spark.createDataFrame([(f"Home {k}/Page {k[::-1]}.md",), (f"Dup {k}.md",), (f"Dup {k[::-1]}.md",)], "path string")
    assert {r.clean for r in files.notion_paths(names).collect()} == {"Home/Page.md", f"Dup {k}.md", f"Dup {k[::-1]}.md"}
    (tmp_path / "m.json").write_text('{"results": [{"id": "1", "memory": "likes tea"}, {"id": "1", "memory": "again"}, {"memory": "no id"}, {"id": "2", "memory": " "}]}')
    got = files.memories(spark, str(tmp_path / "m.json")).collect()
    assert [r.problem for r in got if r.id == "1"] in (["repeated", None], [None, "repeated"])
    assert {r.problem for r in got} == {None, "repeated", "no id", "blank"}
    files.append_audit(spark.createDataFrame([("t", "a", "write", "ok", "p", None, "r", None)], "ts string, agentId string, tool string, outcome string, path string, target string, revision string, detail string"), str(tmp_path / "log"))
    assert files.audit_log(spark, str(tmp_path / "log")).first().tool == "write"
    assert T is not None


def test_notion_links_and_report(spark):
    from loomnote.sources import files

    k = "0123456789abcdef" * 2
    rows = [(f"see [a b](x/My%20%C3%A9%2B%20page%20{k}.md) 100%20 and [c](d.md)",), ("plain",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(files.notion_links(F.col("t"))).collect()]
    assert got == ["see [[My é+ page|a b]] 100%20 and [c](d.md)", "plain"]
    table = spark.createDataFrame([("a.md",), ("t.CSV",), ("p.png",)], "path string")
    assert {r.path: r.outcome for r in files.notion_report(table).collect()} == {"a.md": "imported", "t.CSV": "skipped table", "p.png": "skipped"}
