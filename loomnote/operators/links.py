"""Wikilinks: resolution, backlinks, federation, rewriting; tags and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomnote.functions import text as T


def extract(notes: DataFrame) -> DataFrame:
    """src, pos, target: the wikilinks of notes (path, text) in order."""
    return notes.select(F.col("path").alias("src"), F.posexplode(T.wikilinks(F.col("text"))).alias("pos", "target"))


def resolve(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds `resolved`: the exact path, else the path with .md, else a unique basename, else null.

    One join on what a target may equal: each path offers itself, itself without .md, and
    its lower-cased basename if no other path has it; the best offer wins.
    """
    own = paths.select("path").distinct()
    base = F.lower(T.stem(F.col("path")))
    unique = own.groupBy(base.alias("name")).agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1")
    exact = own.select(F.col("path").alias("k1"), F.col("path").alias("p1"))
    plus = own.where(F.col("path").endswith(".md")).select(F.regexp_replace("path", r"\.md$", "").alias("k2"), F.col("path").alias("p2"))
    named = unique.select(F.col("name").alias("k3"), F.col("path").alias("p3"))
    page = T.link_page(F.col("target"))
    rows = links.withColumn("page", page).withColumn("name", F.lower(T.stem(page)))
    joined = rows.join(exact, F.col("page") == F.col("k1"), "left").join(plus, F.col("page") == F.col("k2"), "left").join(named, F.col("name") == F.col("k3"), "left")
    return joined.select(*links.columns, F.coalesce("p1", "p2", "p3").alias("resolved"))


def backlinks(resolved: DataFrame) -> DataFrame:
    """target_path, backlinks, sources: the notes that link to each note, counted."""
    once = resolved.where("resolved is not null").select(F.col("resolved").alias("target_path"), "src").distinct()
    return once.groupBy("target_path").agg(F.count("*").alias("backlinks"), F.min("src").alias("first_source"))


def visible(resolved: DataFrame, hidden: DataFrame) -> DataFrame:
    """Links that lead somewhere, without those from or to a hidden note (path)."""
    out = resolved.where("resolved is not null")
    for end in ("src", "resolved"):
        out = out.join(hidden.select(F.col("path").alias(end)).distinct(), end, "left_anti")
    return out.select(*resolved.columns)


def resolve_federated(links: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds target_vault and resolved.  `vault:target` names a vault only if there is one."""
    vaults = paths.select(F.col("vault").alias("known")).distinct()
    prefix = F.when(F.contains(F.col("target"), F.lit(":")), F.substring_index("target", ":", 1))
    rows = links.withColumn("prefix", prefix).join(vaults, F.col("prefix") == F.col("known"), "left")
    named = F.col("known").isNotNull()
    page = T.link_page(F.when(named, F.expr("substring(target, length(prefix) + 2)")).otherwise(F.col("target")))
    rows = rows.withColumn("tv", F.when(named, F.col("known")).otherwise(F.col("vault"))).withColumn("page", page).withColumn("name", F.lower(T.stem(page)))
    own = paths.select("vault", "path").distinct()
    exact = own.select(F.col("vault").alias("v1"), F.col("path").alias("p1"))
    plus = own.where(F.col("path").endswith(".md")).select(F.col("vault").alias("v2"), F.regexp_replace("path", r"\.md$", "").alias("k2"), F.col("path").alias("p2"))
    unique = own.groupBy(F.col("vault").alias("v3"), F.lower(T.stem(F.col("path"))).alias("k3")).agg(F.min("path").alias("p3"), F.count("*").alias("n")).where("n = 1").drop("n")
    joined = rows.join(exact, (F.col("tv") == F.col("v1")) & (F.col("page") == F.col("p1")), "left")
    joined = joined.join(plus, (F.col("tv") == F.col("v2")) & (F.col("page") == F.col("k2")), "left")
    joined = joined.join(unique, (F.col("tv") == F.col("v3")) & (F.col("name") == F.col("k3")), "left")
    return joined.select(*links.columns, F.col("tv").alias("target_vault"), F.coalesce("p1", "p2", "p3").alias("resolved"))


def rewritten(text: Column, old: Column, new: Column) -> Column:
    """A text whose links to page `old` name page `new`; headings and aliases stay."""
    quoted = F.concat(F.lit(r"\[\["), F.regexp_replace(old, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit(r"(?=[\]#|])"))
    return F.regexp_replace(text, quoted, F.concat(F.lit("[["), F.regexp_replace(new, r"([\\$])", r"\\$1")))


def relinked(text: Column, vault: Column, old: Column, new: Column) -> Column:
    """A text of another vault whose qualified links `[[vault:old]]` name `new` instead.

    A link fits by its whole path or its last name, with or without .md; heading and alias stay.
    """
    escape = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    to = F.regexp_replace(new, r"\.md$", "")
    pattern = F.concat(F.lit(r"\[\[\s*"), escape(vault), F.lit(r"\s*:\s*(?:[^\[\]|#:]*/)?"), escape(T.stem(old)), F.lit(r"(?:\.md)?\s*((?:#|\|)[^\[\]]*)?\]\]"))
    made = F.concat(F.lit("[["), vault, F.lit(":"), to)
    return F.regexp_replace(text, pattern, F.concat(F.regexp_replace(made, r"([\\$])", r"\\$1"), F.lit("$1]]")))


def relink_others(notes: DataFrame, moves: DataFrame, writable: DataFrame) -> DataFrame:
    """vault, path, text: the notes of other, writable vaults that a move's links change.

    notes: vault, path, text.  moves: moved (a vault), old, new, one row each.  writable: vault.
    """
    rows = notes.join(writable.select("vault").distinct(), "vault", "left_semi").where(F.col("path").endswith(".md") & F.contains(F.col("text"), F.lit("[[")))
    each = rows.crossJoin(F.broadcast(moves)).where(F.col("vault") != F.col("moved"))  # one move
    done = each.select("vault", "path", F.col("text").alias("before"), relinked(F.col("text"), F.col("moved"), F.col("old"), F.col("new")).alias("text"))
    return done.where("text <> before").drop("before")


def tree_totals(paths: DataFrame, prefix: str = "", depth: int = 2, most: int = 500) -> DataFrame:
    """One row: files, root_files (directly at the prefix) and whether folders exceed `most`."""
    rows = paths.where(F.col("path").startswith(prefix)).select(F.substring("path", len(prefix) + 1, 1 << 30).alias("path"))
    files = rows.agg(F.count("*").alias("files"), F.count_if(~F.contains("path", F.lit("/"))).alias("root_files"))
    return files.crossJoin(folder_tree(rows, depth).agg((F.count("*") > most).alias("truncated")))  # one row each


def tree_page(paths: DataFrame, depth: int = 2, most: int = 500) -> DataFrame:
    """The first `most` folders by path, with their files."""
    return folder_tree(paths, depth).orderBy("folder").limit(most)


def tree_nodes(paths: DataFrame) -> DataFrame:
    """path, parent, name, kind (dir or file): the nested tree as rows, each node once; the root's parent is ''."""
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("path"), F.array_join(F.slice(parts, 1, i - 1), "/").alias("parent"), F.element_at(parts, i).alias("name"), (i < F.size(parts)).alias("inner")))
    each = paths.select(F.explode(levels).alias("n")).select("n.*")
    return each.groupBy("path", "parent", "name").agg(F.when(F.max("inner"), "dir").otherwise("file").alias("kind"))


def tag_counts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def folder_tree(paths: DataFrame, depth: int = 2) -> DataFrame:
    """folder, files: files below each folder of at most `depth` segments, at any depth below it."""
    parts = F.split("path", "/")
    levels = F.least(F.size(parts) - 1, F.lit(depth))
    prefixes = F.when(levels > 0, F.transform(F.sequence(F.lit(1), levels), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    return paths.select(F.explode(prefixes).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))
