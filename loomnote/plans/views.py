"""Deterministic views over the test tables, each with the same view as DuckDB SQL.

The tables hold plain documents, vectors, events and conversations; the views give them
the paths, statuses, links and histories that the operators work on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.functions import text as T

START = 1704067200
NOW = START + 60 * 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named() -> tuple[Column, Column]:
    """A document's path and type as a note."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return path, F.element_at(F.array(*map(F.lit, ("policy", "preference", "fact", "episode"))), (F.col("doc_id") % 4 + 1).cast("int"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    path, kind = _named()
    status = F.when(F.col("toxic") == 1, "revoked").when(F.col("quality") == 0, "provisional").when(F.col("quality") == 1, "active")
    return d.join(known, "doc_id", "left").select(
        "doc_id", path.alias("path"), F.col("source").alias("vault"), "lang", F.substring_index("text", "\n", 1).alias("title"), "text",
        F.array("lang", "source").alias("tags"), (F.lit(START).cast("long") + F.col("doc_id") * 3600).alias("created"), kind.alias("type"), status.alias("status"),
        F.when(F.col("doc_id") % 17 == 0, F.lit(START).cast("long") + F.col("doc_id") * 3600 + 2592000).alias("expires_at"),
        F.when(F.col("doc_id") % 23 == 0, F.lit("newer.md")).alias("superseded_by"),
        (F.col("doc_id") % 29 == 0).alias("needs_review"), F.when(F.col("doc_id") % 31 == 0, F.lit("other.md")).alias("contradicts"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, type, text of the notes, as often as `notes` has them.

    Labels add rows where a document has several; where none has, they are not joined, so
    that the texts are not shuffled.
    """
    several = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not several.isEmpty():
        return notes(spark, sf_dir).select("path", "type", "text")
    path, kind = _named()
    return table(spark, sf_dir, "documents").select(path.alias("path"), kind.alias("type"), "text")


NOTES = f"""notes AS (SELECT d.doc_id, d.source || '/' || d.doc_id || '.md' AS path, d.source AS vault, d.lang, string_split(d.text, chr(10))[1] AS title, d.text,
  [d.lang, d.source] AS tags, {START}::BIGINT + d.doc_id * 3600 AS created,
  CASE d.doc_id % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'preference' WHEN 2 THEN 'fact' ELSE 'episode' END AS type,
  CASE WHEN l.toxic = 1 THEN 'revoked' WHEN l.quality = 0 THEN 'provisional' WHEN l.quality = 1 THEN 'active' END AS status,
  CASE WHEN d.doc_id % 17 = 0 THEN {START}::BIGINT + d.doc_id * 3600 + 2592000 END AS expires_at,
  CASE WHEN d.doc_id % 23 = 0 THEN 'newer.md' END AS superseded_by, d.doc_id % 29 = 0 AS needs_review,
  CASE WHEN d.doc_id % 31 = 0 THEN 'other.md' END AS contradicts
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line that is not blank; its heading is the note's type and language."""
    rows = notes(spark, sf_dir).select("*", F.posexplode(F.split("text", "\n")).alias("ord", "line")).drop("text")
    rows = rows.where(F.trim("line") != "").withColumnRenamed("line", "text")
    return rows.withColumn("chunk_id", F.concat("path", F.lit("#"), F.col("ord").cast("string"))).withColumn("heading", F.concat_ws(" ", "type", "lang"))


CHUNKS = NOTES + """, chunks AS (SELECT * EXCLUDE (text, lines, i), lines[i] AS text, i - 1 AS ord, path || '#' || (i - 1) AS chunk_id, type || ' ' || lang AS heading
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM notes)) WHERE trim(lines[i]) <> '')"""

WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's words."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", T.words(F.col("text")).alias("terms"))


QUERIES = f"queries AS (SELECT item_id AS query_id, text, {WORDS.format('text')} AS terms FROM benchmark)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the notes that have one."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    return v.join(notes(spark, sf_dir), "doc_id")


VECTORS = NOTES + ", vectors AS (SELECT n.*, e.embedding::DOUBLE[] AS vec, e.label FROM embeddings e JOIN notes n ON n.doc_id = e.vec_id)"


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item asks with the vector of the same number."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), "query_id")


VECTOR_QUERIES = "vector_queries AS (SELECT e.vec_id AS query_id, e.embedding::DOUBLE[] AS vec FROM embeddings e JOIN benchmark b ON b.item_id = e.vec_id)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three links a note: a basename, a path without .md, and for every tenth a broken one."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    rows = notes(spark, sf_dir).select("doc_id", "path", "vault").crossJoin(F.broadcast(n))  # one row
    other = F.col("doc_id") % 1000
    made = F.array(
        ((F.col("doc_id") * 13 + 17) % F.col("n")).cast("string"),
        F.concat(F.lit("src"), (other % 20).cast("string"), F.lit("/"), other.cast("string")),
        F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("missing-"), F.col("doc_id").cast("string"))),
    )
    each = rows.select("vault", F.col("path").alias("src"), F.posexplode(made).alias("pos", "target"))
    return each.where("target is not null").select("vault", "src", F.col("pos").cast("long").alias("pos"), "target")


LINKS = NOTES + """, links AS (SELECT vault, path AS src, i - 1 AS pos, made[i] AS target FROM (SELECT *, unnest(range(1, 4)) AS i FROM (SELECT *,
  [((doc_id * 13 + 17) % (SELECT count(*) FROM documents))::VARCHAR, 'src' || (doc_id % 1000 % 20) || '/' || (doc_id % 1000), CASE WHEN doc_id % 10 = 0 THEN 'missing-' || doc_id END] AS made FROM notes))
  WHERE made[i] IS NOT NULL),
 basenames AS (SELECT lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '')) AS name, min(path) AS path FROM notes GROUP BY 1 HAVING count(*) = 1),
 resolved AS (SELECT l.*, coalesce(a.path, b.path, c.path) AS resolved FROM links l LEFT JOIN notes a ON a.path = l.target LEFT JOIN notes b ON b.path = l.target || '.md'
  LEFT JOIN basenames c ON c.name = lower(regexp_replace(regexp_extract(l.target, '[^/]*$'), '\\.md$', '')))"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits that each change one note."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("note-"), F.get_json_object("props", "$.k"))
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type").isin("view", "click"), "modify").when(F.col("event_type") == "purchase", "rename").otherwise("delete")
    rows = e.select(F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("epoch"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author"), op.alias("op"), path.alias("path"), F.round(F.col("value"), 3).alias("ms"))
    message = F.when(F.col("op") == "delete", F.concat(F.lit("delete: "), "path", F.lit(" -> .trash/"), "path")).otherwise(F.concat_ws(": ", "op", "path"))
    return rows.select("*", F.sha1(F.col("seq").cast("string").cast("binary")).alias("commit"), F.sha1(F.concat(F.lit("r"), F.col("seq").cast("string")).cast("binary")).alias("revision"), F.when(F.col("op") == "rename", F.concat(F.lit("old/"), "path")).alias("new_path"), message.alias("message"))


COMMITS = """commits AS (SELECT *, sha1(seq::VARCHAR) AS commit, sha1('r' || seq) AS revision, CASE WHEN op = 'rename' THEN 'old/' || path END AS new_path,
  CASE WHEN op = 'delete' THEN 'delete: ' || path || ' -> .trash/' || path ELSE op || ': ' || path END AS message
  FROM (SELECT event_id AS seq, epoch_us(ts) // 1000000 AS epoch, 'u' || user_id AS author,
   CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'modify' WHEN 'click' THEN 'modify' WHEN 'purchase' THEN 'rename' ELSE 'delete' END AS op,
   'note-' || json_extract_string(props, '$.k') AS path, round(value, 3) AS ms FROM events))"""


def snapshot_sql(name: str, upto: str) -> str:
    return f"""{name} AS (SELECT path, revision, seq FROM (SELECT path, revision, seq, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS turn FROM (
  SELECT seq, path, CASE WHEN op IN ('delete', 'rename') THEN NULL ELSE revision END AS revision FROM commits WHERE seq <= {upto}
  UNION ALL SELECT seq, new_path, revision FROM commits WHERE op = 'rename' AND seq <= {upto})) WHERE turn = 1 AND revision IS NOT NULL)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a capture of all of it up to there."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.octet_length("text").cast("long").alias("bytes"), (F.lit(START) + F.col("conv_id") * 60 + F.col("turn")).alias("ended_at"), (F.lit(START) + F.col("conv_id") * 60 - F.col("turn")).alias("started_at"))


CAPTURES = f"captures AS (SELECT conv_id AS session_id, strlen(text)::BIGINT AS bytes, {START} + conv_id * 60 + turn AS ended_at, {START} + conv_id * 60 - turn AS started_at FROM conversations)"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base, ours and theirs: three states of the parts, changed and deleted by number."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 6 == 0, ".bin").otherwise(".md")).alias("path"), F.col("p_name").alias("content"))
    k = F.col("p_partkey")
    base = p.where(k % 13 != 0).select("path", F.sha1(F.col("content").cast("binary")).alias("revision"))
    ours = p.where(k % 11 != 0).select("path", F.sha1(F.concat("content", F.when(k % 5 == 0, "!").otherwise("")).cast("binary")).alias("revision"))
    theirs = p.where(k % 17 != 0).select("path", F.sha1(F.concat("content", F.when(k % 7 == 0, "?").when(k % 35 == 5, "!").otherwise("")).cast("binary")).alias("revision"))
    return base, ours, theirs


SIDES = """p AS (SELECT p_partkey AS k, 'part/' || p_partkey || CASE WHEN p_partkey % 6 = 0 THEN '.bin' ELSE '.md' END AS path, p_name AS content FROM part),
 base AS (SELECT path, sha1(content) AS revision FROM p WHERE k % 13 <> 0),
 ours AS (SELECT path, sha1(content || CASE WHEN k % 5 = 0 THEN '!' ELSE '' END) AS revision FROM p WHERE k % 11 <> 0),
 theirs AS (SELECT path, sha1(content || CASE WHEN k % 7 = 0 THEN '?' WHEN k % 35 = 5 THEN '!' ELSE '' END) AS revision FROM p WHERE k % 17 <> 0)"""
