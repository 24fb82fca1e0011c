"""Texts of a megabyte in every shape that a pattern repeats over; none may end the JVM."""

import pytest
from pyspark.sql import functions as F

from loomnote.functions import text as T
from loomnote.operators import links, scan
from loomnote.sources import files
from loomnote.vault import Vault

N = 1_000_000
HEX = "0123456789abcdef" * 2


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_links(spark):
    long = "x" * N
    text = f"[[{long}]] [[{'a|' * (N // 2)}]] [[a{chr(92)}|b|c]] [[{chr(92)}|{'|' * 1000}]] [[ d/e// ]] [[{'[' * 1000}" + "]" * 1000
    assert one(spark, text, T.wikilinks) == [long, "a", "a|b", "|", "d/e"]
    assert one(spark, f"[[bb|{'b' * N}]]", lambda t: links.rewritten(t, F.lit("bb"), F.lit("c"))) == f"[[c|{'b' * N}]]"


def test_private_spans(spark):
    got = one(spark, "a\n<private>" + "x\n" * (N // 2) + "</PRIVATE>" + "y" * N + "<private>" + "z" * N, T.masked_private)
    assert got == "a\n" + "\n" * (N // 2) + "y" * N
    text = "<private>a\nb</private>c" * 10_000
    assert one(spark, text, T.masked_private) == "\nc" * 10_000
    assert one(spark, text, T.without_private) == "c" * 10_000
    assert one(spark, "no span " * 1000, T.masked_private) == "no span " * 1000 and one(spark, None, T.masked_private) is None


def test_notion_links(spark):
    text = "x" * N + f"[A b](dir/a%20b%20{HEX}.md) [c](d {HEX}.md) [e](plain.md)" + "(y)" * 100_000
    assert one(spark, text, files.notion_links) == "x" * N + "[[a b|A b]] [[d|c]] [e](plain.md)" + "(y)" * 100_000


@pytest.mark.parametrize(
    ("line", "rules"),
    [
        ("-----BEGIN " + "AB " * (N // 3) + "PRIVATE KEY-----", ["private-key"]),
        ("-----BEGIN " + "AB " * (N // 3) + " PRIVATE KEY-----", []),
        ("-----BEGIN PRIVATE KEY-----", ["private-key"]),
        ("-----BEGIN  PRIVATE KEY-----", []),
        ("-----BEGIN RSAPRIVATE KEY-----", []),
        ("-----BEGIN RSA PRIVATE KEY-----", ["private-key"]),
        ("password = " + "a" * N, ["assignment"]),
        ("eyJ" + "a" * N + "." + "b" * N + "." + "c" * 8, ["jwt"]),
        ("ghp_" + "a" * N, ["github-token"]),
        ("xoxb-" + "-" * N, ["slack-token"]),
    ],
)
def test_secrets(spark, line, rules):
    found = scan.findings(spark.createDataFrame([(1, "first\n" + line)], "doc_id long, text string"))
    assert [(r.rule, r.line) for r in found.collect()] == [(rule, 2) for rule in rules]


def test_highlight_takes_the_longest_of_terms_that_begin_alike(spark):
    assert one(spark, "alpha gamma delta beta alphabet", lambda t: T.highlighted(t, ["alpha", "gamma", "beta", "alphabet"])) == "**alpha** **gamma** delta **beta** **alphabet**"


def memory(**front):
    body = front.pop("body")
    return "---\ntype: fact\n" + "".join(f"{k.replace('_', '-') if k == 'needs_review' else k}: {v}\n" for k, v in front.items()) + f"---\n{body}\n"


def test_retired_and_other_subjects_take_no_memory_away(spark):
    rows = [
        ("m/old.md", memory(status="revoked", body="The team drinks green tea")),
        ("m/past.md", memory(superseded_by="m/new.md", body="The office is in Rome")),
        ("m/ann.md", memory(subject="Ann", body="likes the window seat")),
    ]
    vault = Vault.of_notes(spark.createDataFrame(rows, "path string, text string"))
    assert vault.remember("the TEAM drinks green tea")[0].detail == "new"
    assert vault.remember("the office is in ROME")[0].detail == "new"
    assert vault.remember("Likes the window seat", subject="Bob")[0].detail == "new"
    assert vault.remember("Likes the window seat", subject="ANN")[0].detail == "duplicate of m/ann.md"
    out, after = vault.remember("Likes the aisle seat", subject="Bob: junior")
    assert out.detail == "new" and after.parsed.where("path like 'memory/%'").first().subject == "Bob: junior"


def test_vectors_decide_where_the_vault_has_them(spark):
    rows = [("m/a.md", memory(status="active", body="one wording of it")), ("m/b.md", memory(status="active", body="something else"))]
    vault = Vault.of_notes(spark.createDataFrame(rows, "path string, text string"))
    vec = F.when(F.col("path") == "m/a.md", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    held = Vault(spark, vault.changes, vault.chunks.select("content_hash", vec.alias("vec")))
    assert held.remember("quite other terms", vector=[1.0, 0.01])[0].detail == "duplicate of m/a.md"
    assert held.remember("quite other terms", vector=[0.9, 0.3])[0].detail == "uncertain"


def test_a_move_rewrites_every_linking_note_in_one_commit(spark):
    rows = [("a.md", "self [[a]] and [[dir/a]]"), *((f"n{i}.md", f"[[a]] [[a#h|x]] [[n{i}]]") for i in range(30)), ("other.md", "[[b]]")]
    vault = Vault.of_notes(spark.createDataFrame(rows, "path string, text string"))
    out, after = vault.move("a.md", "dir/z.md", epoch=7)
    texts = {r.path: r.text for r in after.snapshot().collect()}
    assert out.status == "ok" and texts["dir/z.md"].startswith("self [[z]]") and texts["other.md"] == "[[b]]"
    assert all(texts[f"n{i}.md"] == f"[[z]] [[z#h|x]] [[n{i}]]" for i in range(30))
    last = after.changes.where("seq = 2").collect()
    assert len(last) == 31 and {(r.epoch, r.message) for r in last} == {(7, "move: a.md -> dir/z.md")}
