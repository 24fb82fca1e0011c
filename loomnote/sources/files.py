"""Files as tables: vaults of Markdown, exports of other tools, JSON logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomnote.functions import text as T
from loomnote.operators.links import resolve


def _relative(root: str) -> Column:
    """A file's path below the root, decoded."""
    return F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^.*?" + _quoted(root.rstrip("/")) + "/", "")


def _quoted(text: str) -> str:
    import re

    return re.escape(text.split("://", 1)[-1].lstrip("/")).replace("/", r"/")


def vault_files(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, content of every file; dot-files and files in dot-folders are not user files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select(_relative(root).alias("path"), F.col("length").alias("bytes"), "content")
    return rows.where(~F.col("path").rlike(r"(^|/)\."))


def vault_notes(spark: SparkSession, root: str) -> DataFrame:
    """path, text, revision of every Markdown note."""
    rows = vault_files(spark, root).where(F.col("path").endswith(".md")).select("path", F.decode("content", "utf-8").alias("text"))
    return rows.withColumn("revision", T.blob_id(F.col("text")))


def watch_notes(spark: SparkSession, root: str) -> DataFrame:
    """The notes of a folder as a stream: each file once, as it appears."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return files.select(_relative(root).alias("path"), F.decode("content", "utf-8").alias("text"), F.col("modificationTime").alias("ts"))


LISTED = "path string, bytes long, modified timestamp, revision string"
SEEN = "seq long, path string, op string, new_path string, revision string, text string, author string, ts timestamp"


def listing(spark: SparkSession, root: str, known: DataFrame | None = None, pattern: str = "*.md") -> DataFrame:
    """path, bytes, modified, revision of a folder's files; those of a size and time that `known` has are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    there = files.select(_relative(root).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(r"(^|/)\."))
    if known is not None:
        there = there.join(known, ["path", "bytes", "modified"], "left")
    else:
        there = there.withColumn("revision", F.lit(None).cast("string"))
    texts = files.select(_relative(root).alias("path"), F.decode("content", "utf-8").alias("text")).join(there.where("revision is null").select("path"), "path", "left_semi")
    read = texts.select("path", T.blob_id(F.col("text")).alias("read"))
    return there.join(read, "path", "left").select("path", "bytes", "modified", F.coalesce("revision", "read").alias("revision"))


def folder_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """op, path, new_path, revision: what turns one listing into another.

    A file that went is taken as renamed to one that came with the same revision; of several
    the first by path go together.  The rest are add, modify and delete.
    """
    old = before.select("path", F.col("revision").alias("was"))
    both = old.join(after.select("path", "revision"), "path", "full_outer")
    turn = Window.partitionBy("content").orderBy("path")
    gone = both.where("revision is null").select(F.col("was").alias("content"), "path").withColumn("turn", F.row_number().over(turn))
    came = both.where("was is null").select(F.col("revision").alias("content"), F.col("path")).withColumn("turn", F.row_number().over(turn)).withColumnRenamed("path", "new_path")
    moved = gone.join(came, ["content", "turn"], "full_outer")
    op = F.when(F.col("path").isNull(), "add").when(F.col("new_path").isNull(), "delete").otherwise("rename")
    renamed = F.when(F.col("path").isNotNull(), F.col("new_path"))
    moved = moved.select(op.alias("op"), F.coalesce("path", "new_path").alias("path"), renamed.alias("new_path"), F.when(F.col("new_path").isNotNull(), F.col("content")).alias("revision"))
    changed = both.where("was <> revision").select(F.lit("modify").alias("op"), "path", F.lit(None).cast("string").alias("new_path"), "revision")
    return moved.unionAll(changed)


def look(spark: SparkSession, root: str, kept: str, number: int, author: str = "external", pattern: str = "*.md") -> None:
    """One look at a folder: what changed since look `number` - 1 is written as changes below `kept`/changes.

    The listing is kept as `kept`/listing/`number`.  A look that is repeated after a failure
    writes the same two folders again; listings before the last two go.  Changes have the
    columns of a vault's stream (seq by look and path).
    """
    version = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{kept}/listing/{n}")
    store = version(0).getFileSystem(spark._jsc.hadoopConfiguration())
    if number and not store.exists(version(number - 1)):
        raise FileNotFoundError(f"look {number - 1} is missing below {kept}")
    before = spark.read.schema(LISTED).parquet(f"{kept}/listing/{number - 1}") if number else spark.createDataFrame([], LISTED)
    listing(spark, root, before, pattern).write.mode("overwrite").parquet(f"{kept}/listing/{number}")
    after = spark.read.schema(LISTED).parquet(f"{kept}/listing/{number}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    texts = files.select(_relative(root).alias("at"), F.decode("content", "utf-8").alias("text"))
    rows = folder_changes(before, after).withColumn("at", F.coalesce("new_path", "path"))
    place = F.row_number().over(Window.orderBy("path", "op"))  # the changes of one look
    rows = rows.join(texts, "at", "left").withColumn("seq", F.lit(number) * (1 << 32) + place)
    kept_text = F.when(F.col("op") != "delete", F.col("text"))
    rows.select("seq", "path", "op", "new_path", "revision", kept_text.alias("text"), F.lit(author).alias("author"), F.current_timestamp().alias("ts")).write.mode("overwrite").parquet(f"{kept}/changes/look={number}")
    if number > 1:
        store.delete(version(number - 2), True)


def watch_folder(spark: SparkSession, root: str, kept: str, checkpoint: str, author: str = "external"):
    """A stream that looks at a folder again and again; start it with a trigger.

    `kept`/changes is a folder for `streaming.change_stream`: files added, edited, renamed
    and deleted in place all come through it.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, number: look(spark, root, kept, number, author)).option("checkpointLocation", checkpoint)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a log of JSON lines."""
    return spark.read.schema("ts string, agentId string, tool string, outcome string, path string, target string, revision string, detail string").json(path)


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def import_plan(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """path, outcome: imported, unchanged or skipped (there with other content)."""
    have = current.select("path", F.col("text").alias("have"), F.lit(True).alias("there"))
    outcome = F.when(F.col("there").isNull(), "imported").when(F.col("have") == F.col("text"), "unchanged").otherwise("skipped")
    return incoming.join(have, "path", "left").select("path", outcome.alias("outcome"))


def notion_paths(files: DataFrame) -> DataFrame:
    """path, clean: an export's paths without their ids, unless two siblings would then be one."""
    parts = F.split("path", "/")
    rows = files.select("path", F.transform(parts, lambda p: F.regexp_replace(p, r"\s[0-9a-f]{32}(?=(\.\w+)?$)", "")).alias("short"), parts.alias("long"))
    each = rows.select("path", F.posexplode(F.arrays_zip("short", "long")).alias("i", "s"), "long")
    each = each.select("path", "i", F.col("s.short").alias("short"), F.col("s.long").alias("own"), F.array_join(F.slice("long", 1, F.col("i")), "/").alias("parent"))
    siblings = each.groupBy("parent", F.lower("short").alias("key")).agg(F.count_distinct("own").alias("n"))
    named = each.withColumn("key", F.lower("short")).join(siblings, ["parent", "key"])
    kept = F.when(F.col("n") > 1, F.col("own")).otherwise(F.col("short"))
    return named.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", kept.alias("name")))).alias("names")).select("path", F.array_join(F.transform("names", lambda x: x["name"]), "/").alias("clean"))


def notion_links(text: Column) -> Column:
    """Markdown links to .md files as wikilinks, without ids; a link's name is URL-decoded."""
    link = r"\[([^\]]+)\]\((?:[^)]*/)?([^)/]+?)(?:%20| )[0-9a-f]{32}\.md\)"

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, link, 2)
        plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
        return F.concat(F.lit("[["), plain, F.lit("|"), F.regexp_extract(part, link, 1), F.lit("]]"))

    return F.when(F.contains(text, F.lit(".md)")), T.mapped(text, "(?s)" + link, one)).otherwise(text)


def notion_report(files: DataFrame) -> DataFrame:
    """path, outcome: notes of an export are imported, its tables (.csv) and other files skipped."""
    return files.select("path", F.when(F.lower("path").endswith(".md"), "imported").when(F.lower("path").endswith(".csv"), "skipped table").otherwise("skipped").alias("outcome"))


#: Fixed value: the largest JSON export that is read.
EXPORT_BYTES = 64 << 20
MEMORY = "array<struct<id: string, memory: string, text: string, created_at: string, user_id: string, metadata: string>>"


def memories(spark: SparkSession, path: str, folder: str = "memory") -> DataFrame:
    """id, path, text, problem of a JSON export: an array, or an object with results or memories.

    A row without id or words, and all but the first row of an id, carry a problem.  A file of
    more than EXPORT_BYTES is refused.
    """
    if spark.read.format("binaryFile").load(path).where(F.col("length") > EXPORT_BYTES).select("path").first():
        raise ValueError(f"an export may have {EXPORT_BYTES} bytes at most")
    raw = spark.read.text(path, wholetext=True)
    whole = F.coalesce(F.get_json_object("value", "$.results"), F.get_json_object("value", "$.memories"), F.col("value"))
    rows = raw.select(F.posexplode(F.from_json(whole, MEMORY)).alias("at", "m")).select("at", F.col("m.id").alias("id"), F.coalesce("m.memory", "m.text").alias("body"))
    first = rows.where("id is not null").groupBy("id").agg(F.min("at").alias("first"))
    rows = rows.join(first, "id", "left")
    problem = F.when(F.coalesce("id", F.lit("")) == "", "no id").when(F.trim(F.coalesce("body", F.lit(""))) == "", "blank").when(F.col("at") != F.col("first"), "repeated")
    return rows.select("id", T.memory_path(folder, F.lit("fact"), F.coalesce("body", F.lit(""))).alias("path"), F.col("body").alias("text"), problem.alias("problem"))


def relinked(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links with new_target: those that resolve to nothing but name one note's title or permalink.

    notes: path, title, permalink.
    """
    resolved = resolve(links, notes)
    by_title = notes.where("title is not null").groupBy(F.lower("title").alias("k1")).agg(F.min("path").alias("t"), F.count("*").alias("n")).where("n = 1").drop("n")
    by_link = notes.where("permalink is not null").groupBy(F.lower("permalink").alias("k2")).agg(F.min("path").alias("l"), F.count("*").alias("n")).where("n = 1").drop("n")
    name = F.lower("target")
    joined = resolved.join(by_title, name == F.col("k1"), "left").join(by_link, name == F.col("k2"), "left")
    return joined.select(*links.columns, "resolved", F.when(F.col("resolved").isNull(), F.coalesce("t", "l")).alias("new_target"))
