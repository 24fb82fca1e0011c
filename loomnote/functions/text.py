"""Text as columns: words, hashes, private spans, links, titles, snippets.

Lengths count code points.  Every function takes and returns columns and stays inside
generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that stand for "yes" in frontmatter.
TRUE_WORDS = ("true", "yes", "1", "on")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def normalised(text: Column) -> Column:
    """Words joined by single blanks, for comparing bodies."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def blob_id(text: Column) -> Column:
    """The id that git gives a blob of this text."""
    raw = F.encode(text, "utf-8")
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string")), "utf-8")
    return F.sha1(F.concat(head, F.lit(bytearray(b"\x00")), raw))


def content_hash(heading: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(heading, F.lit("")), F.lit("\n"), text), 256)


def memory_path(folder: str, kind: Column, content: Column) -> Column:
    """Where a memory of this kind and content is kept."""
    return F.concat(F.lit(folder + "/"), kind, F.lit("/"), F.substring(F.sha2(F.concat(kind, F.lit("\n"), F.trim(content)), 256), 1, 12), F.lit(".md"))


def without_private(text: Column) -> Column:
    """The text without private spans; an unclosed one hides the rest."""
    gone = F.regexp_replace(text, r"(?is)<private>(?:.*?</private>|.*)", "")
    return F.when(F.contains(F.lower(text), F.lit("<private>")), gone).otherwise(text)


def mapped(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with every match of a pattern changed; what stands between matches stays."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, F.concat(F.transform(found, change), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def masked_private(text: Column) -> Column:
    """The text with private spans emptied but for their line feeds, so line numbers hold."""
    masked = mapped(text, r"(?is)<private>(?:.*?</private>|.*)", lambda p: F.regexp_replace(p, r"[^\n]", ""))
    return F.when(F.contains(F.lower(text), F.lit("<private>")), masked).otherwise(text)


def tokens_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def slug(text: Column, size: int = 40) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(made, 1, size), r"-+$", "")
    return F.when(cut == "", F.lit("none")).otherwise(cut)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.md$", "")


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def wikilinks(text: Column) -> Column:
    """Targets of `[[...]]` in order: what stands before the first bar without a backslash, less last slashes."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\[([^\[\]]+?)\]\]"), F.lit(1))
    clean = F.transform(found, lambda t: F.regexp_replace(F.trim(F.replace(F.get(F.split(t, r"(?<!\\)\|", 2), F.lit(0)), F.lit("\\|"), F.lit("|"))), r"/+$", ""))
    return F.filter(clean, lambda t: t != "")


def link_page(target: Column) -> Column:
    """A link's page: the target without its heading."""
    return F.trim(F.substring_index(target, "#", 1))


def bold_stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"\*\*(.+?)\*\*", "$1")


def snippet(text: Column, terms: Column, window: int = 160, before: int = 53) -> Column:
    """`window` characters around the earliest term, white space collapsed, with ellipses."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    hits = F.filter(F.transform(terms, lambda t: F.instr(F.lower(flat), t)), lambda p: p > 0)
    first = F.coalesce(F.array_min(hits), F.lit(1))
    start = F.greatest(first - before, F.lit(1))
    end = start + window
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(""), F.substring(flat, start, F.lit(window)), F.when(end <= F.length(flat), F.lit("…")).otherwise(""))


def highlighted(text: Column, terms: list[str], window: int = 160) -> Column:
    """A snippet around the earliest term with `**` around what matches.

    Of terms that begin alike the longest is marked; without a match it is the text's beginning.
    """
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    known = [t for t in dict.fromkeys(x.lower() for x in terms) if len(t) > 1]
    places = [F.instr(F.lower(flat), F.lit(t)) for t in known]
    at = F.array_min(F.filter(F.array(*places), lambda p: p > 0)) if known else F.lit(None).cast("int")
    start = F.greatest(at - window // 3, F.lit(1))
    core = F.substring(flat, start, F.lit(window))
    if known:
        either = "|".join("".join(c if c.isalnum() else "\\" + c for c in t) for t in sorted(known, key=len, reverse=True))
        core = F.regexp_replace(core, "(?iu)" + either, r"**$0**")
    found = F.concat(F.when(start > 1, F.lit("…")).otherwise(""), core, F.when(start + window <= F.length(flat), F.lit("…")).otherwise(""))
    plain = F.concat(F.substring(flat, 1, window), F.when(F.length(flat) > window, F.lit("…")).otherwise(""))
    return F.when(at.isNull(), plain).otherwise(found)


def language(text: Column) -> Column:
    """`ru` where Cyrillic letters outnumber Latin ones, else `en`."""
    cyrillic = F.regexp_count(text, F.lit(r"\p{IsCyrillic}"))
    return F.when(cyrillic > F.regexp_count(text, F.lit(r"\p{IsLatin}")), F.lit("ru")).otherwise(F.lit("en"))


def epoch(value: Column) -> Column:
    """Seconds since 1970 of an ISO instant, an ISO date (its start) or a number; else null."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^-?\d{1,18}$"), text.try_cast("long"))
    return F.coalesce(number, F.unix_timestamp(text.try_cast("timestamp")))


def as_of(value: Column) -> Column:
    """Like `epoch`, but a bare date means its last second."""
    text = F.trim(value.cast("string"))
    whole_day = F.unix_timestamp(F.date_add(text.try_cast("date"), 1).cast("timestamp")) - 1
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), whole_day).otherwise(epoch(value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays; two empty ones are equal."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)
