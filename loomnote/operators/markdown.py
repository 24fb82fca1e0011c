"""Markdown notes: frontmatter, chunks, edits, diffs and merges of whole texts.

The functions are plain Python over one text; the DataFrame wrappers run them over Arrow
batches.  YAML is read with PyYAML where there is one, else by a reader of flat keys.
"""

from __future__ import annotations

import datetime as dt
import difflib
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

try:
    import yaml
except ImportError:  # optional
    yaml = None

#: A chunk's budget, and words for "yes".
CHUNK_CHARS = 2000
TRUE_WORDS = {"true", "yes", "1", "on"}
FENCE = re.compile(r"\A﻿?---\r?\n(.*?)\r?\n?---[ \t]*(?:\r?\n|\Z)", re.S)
HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
PRIVATE = re.compile(r"<private>(?:.*?</private>|.*)", re.S | re.I)


def split_frontmatter(raw: str) -> tuple[dict, str]:
    """The frontmatter's keys and the body; what cannot be read is empty, never an error."""
    m = FENCE.match(raw)
    if not m:
        return {}, raw
    return read_yaml(m[1]), raw[m.end() :]


def read_yaml(text: str) -> dict:
    if yaml is not None:
        try:
            found = yaml.safe_load(text)
        except (yaml.YAMLError, ValueError):
            return {}
        return {str(k): v for k, v in found.items()} if isinstance(found, dict) else {}
    out: dict = {}
    last = None
    for line in text.splitlines():
        if (m := re.match(r"^\s+-\s+(.*)$", line)) and last is not None:
            out[last] = [*(out[last] if isinstance(out[last], list) else []), m[1].strip("\"' ")]
        elif m := re.match(r"^([\w-]+):\s*(.*)$", line):
            last, value = m[1], m[2].strip()
            out[last] = [v.strip("\"' ") for v in value[1:-1].split(",") if v.strip()] if value[:1] == "[" and value[-1:] == "]" else value.strip("\"'") or None
    return out


def epoch(value) -> int | None:
    """Seconds of an instant, a date (its start) or a number; null if it is none of these."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return int(value)
    if isinstance(value, dt.datetime):
        return int((value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)).timestamp())
    if isinstance(value, dt.date):
        return int(dt.datetime(value.year, value.month, value.day, tzinfo=dt.timezone.utc).timestamp())
    try:
        return epoch(dt.datetime.fromisoformat(str(value).strip().replace("Z", "+00:00")))
    except ValueError:
        return int(value) if re.fullmatch(r"-?\d+", str(value).strip()) else None


def tags(value) -> list[str]:
    items = value if isinstance(value, list) else re.split(r"[,\s]+", value) if isinstance(value, str) else []
    return [t for t in (str(i).strip().lstrip("#") for i in items if i is not None) if t]


def truthy(value) -> bool:
    return value is True or str(value).strip().lower() in TRUE_WORDS


def chunks(body: str, budget: int = CHUNK_CHARS) -> list[tuple[str | None, str]]:
    """(heading, text) parts: one a heading, split by paragraph, then word, then hard."""
    parts: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in body.split("\n"):
        if m := HEADING.match(line.rstrip("\r")):
            parts.append((m[2].strip(), []))
        else:
            parts[-1][1].append(line)
    out = []
    for heading, lines in parts:
        text = "\n".join(lines).strip()
        if text or heading:
            out += [(heading, piece) for piece in _pieces(text, budget)]
    return out


def _pieces(text: str, budget: int) -> list[str]:
    if len(text) <= budget:
        return [text]
    out, held = [], ""
    units: list[tuple[str, str]] = []
    for paragraph in re.split(r"\n\s*\n", text):
        if len(paragraph) <= budget:
            units.append(("\n\n", paragraph))
            continue
        for word in paragraph.split():
            units += [(" " if i == 0 else "", word[i : i + budget]) for i in range(0, len(word), budget)]
    for joint, unit in units:
        if held and len(held) + len(joint) + len(unit) > budget:
            out.append(held)
            held = unit
        else:
            held = held + joint + unit if held else unit
    return [*out, held] if held else out


def parse(raw: str) -> dict:
    """A note as a record; private notes have no chunks and private spans are left out."""
    front, body = split_frontmatter(raw)
    private = truthy(front.get("private"))
    visible = PRIVATE.sub("", body)
    kept = [] if private else chunks(visible)
    lower = lambda k: str(front[k]).strip().lower() if front.get(k) not in (None, "") else None
    return {
        "title": str(front["title"]) if front.get("title") else title(visible),
        "tags": tags(front.get("tags")),
        "type": lower("type"),
        "status": lower("status"),
        "created": epoch(front.get("created")),
        "expires_at": epoch(front.get("expires_at")),
        "superseded_by": str(front["superseded_by"]) if front.get("superseded_by") else None,
        "needs_review": truthy(front.get("needs-review")),
        "contradicts": str(front["contradicts"]) if front.get("contradicts") else None,
        "subject": str(front["subject"]).strip() if front.get("subject") else None,
        "private": private,
        "chunks": [{"ord": i, "heading": h, "text": t, "content_hash": hashlib.sha256(f"{h or ''}\n{t}".encode()).hexdigest()} for i, (h, t) in enumerate(kept)],
    }


def title(body: str) -> str | None:
    """The first heading, else the first line of prose outside code fences, at most 80 characters."""
    fenced = False
    for line in body.splitlines():
        if line.strip().startswith("```"):
            fenced = not fenced
        elif not fenced and line.strip():
            m = HEADING.match(line)
            return (m[2] if m else re.sub(r"\*\*(.+?)\*\*", r"\1", line)).strip()[:80]
    return None


#: Characters of a note's excerpt and of its summary line.
EXCERPT_CHARS, SUMMARY_CHARS = 280, 160


def prose(body: str) -> list[str]:
    """The lines outside code fences that are neither blank nor headings, without bold marks."""
    out, fenced = [], False
    for line in body.splitlines():
        if line.strip().startswith("```"):
            fenced = not fenced
        elif not fenced and line.strip() and not HEADING.match(line):
            out.append(re.sub(r"\*\*(.+?)\*\*", r"\1", line).strip())
    return out


def excerpt(body: str, size: int = EXCERPT_CHARS) -> str:
    """A note's prose in one line, cut to `size` characters."""
    return " ".join(prose(body))[:size].strip()


def summary(body: str, size: int = SUMMARY_CHARS) -> str | None:
    """The first line of prose, cut to `size` characters."""
    return next(iter(prose(body)), "")[:size].strip() or None


NOTE = "path string, title string, tags array<string>, type string, status string, created long, expires_at long, superseded_by string, needs_review boolean, contradicts string, subject string, private boolean, chunks array<struct<ord: int, heading: string, text: string, content_hash: string>>"


def parse_notes(raw: DataFrame) -> DataFrame:
    """Records of notes (path, text); null texts are empty notes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for piece in parcels(part):
                path, text = piece.column("path").to_pylist(), piece.column("text").to_pylist()
                rows = [{"path": p, **parse(t or "")} for p, t in zip(path, text, strict=True)]
                for row in rows:  # a note without a title has its file's name
                    row["title"] = row["title"] or (row["path"] or "").rsplit("/", 1)[-1].removesuffix(".md") or None
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kinds], schema=kinds)

    kinds = to_arrow_schema(StructType.fromDDL(NOTE))
    return raw.select("path", "text").mapInArrow(run, NOTE)


#: A task parses about so many characters at a time.
PARCEL = 1 << 20


def parcels(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about PARCEL bytes of text, one row at least: what is parsed is held but a slice long."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64) + 64)
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PARCEL, "right")))
        yield batch.slice(start, end - start)
        start = end


def chunk_rows(notes: DataFrame) -> DataFrame:
    """chunk_id, path, ord, heading, text, content_hash of parsed notes."""
    return notes.select("path", F.explode("chunks").alias("c")).select(F.concat_ws("#", "path", F.col("c.ord").cast("string")).alias("chunk_id"), "path", "c.ord", "c.heading", "c.text", "c.content_hash")


def edit(text: str, old: str, new: str, everywhere: bool = False) -> str:
    """Replace an exact passage; none, or several without `everywhere`, is an error."""
    n = text.count(old) if old else 0
    if n == 0:
        raise ValueError("the passage is not in the text")
    if n > 1 and not everywhere:
        raise ValueError(f"the passage is in the text {n} times")
    return text.replace(old, new)


def patch_frontmatter(raw: str, changes: dict[str, str | None]) -> str | None:
    """Set or remove top-level keys, line by line; null where that would change anything else."""
    m = FENCE.match(raw)
    if not m:
        return None
    before = read_yaml(m[1])
    lines = m[1].split("\n")
    for key, value in changes.items():
        at = [i for i, line in enumerate(lines) if re.match(rf"{re.escape(key)}\s*:", line)]
        if len(at) > 1 or at and at[0] + 1 < len(lines) and re.match(r"\s+\S|-\s", lines[at[0] + 1]):
            return None
        if value is None:
            lines = [line for i, line in enumerate(lines) if i not in at]
        elif at:
            lines[at[0]] = f"{key}: {value}"
        else:
            lines.append(f"{key}: {value}")
    after = read_yaml("\n".join(lines))
    if {k: v for k, v in after.items() if k not in changes} != {k: v for k, v in before.items() if k not in changes}:
        return None
    return raw[: m.start(1)] + "\n".join(lines) + raw[m.end(1) :]


def unified(old: str, new: str, name: str = "note") -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{name}", f"b/{name}"))


def merge_lines(base: str, ours: str, theirs: str) -> tuple[str, bool]:
    """Three-way merge by lines: the text, and whether both changed one region differently."""
    b, o, t = (x.splitlines(True) for x in (base, ours, theirs))
    mine = difflib.SequenceMatcher(None, b, o, False).get_matching_blocks()
    other = difflib.SequenceMatcher(None, b, t, False).get_matching_blocks()
    same_o = {i + k: j + k for i, j, n in mine for k in range(n)}
    same_t = {i + k: j + k for i, j, n in other for k in range(n)}
    anchors = [(i, same_o[i], same_t[i]) for i in sorted(set(same_o) & set(same_t))] + [(len(b), len(o), len(t))]
    out, clash, at = [], False, (0, 0, 0)
    for i, j, k in anchors:
        parts = b[at[0] : i], o[at[1] : j], t[at[2] : k]
        if parts[1] == parts[2] or parts[2] == parts[0]:
            out += parts[1]
        elif parts[1] == parts[0]:
            out += parts[2]
        else:
            clash = True
            out += ["<<<<<<< ours\n", *parts[1], "=======\n", *parts[2], ">>>>>>> theirs\n"]
        out += b[i : i + 1]
        at = (i + 1, j + 1, k + 1)
    return "".join(out), clash


_GONE = object()


def merge_value(base, ours, theirs):
    """One frontmatter value of three states and whether it clashes; _GONE stands for a missing key.

    What one side alone has changed, or removed, holds; lists that both have changed are united.
    """
    if ours == theirs or theirs == base:
        return ours, False
    if ours == base:
        return theirs, False
    if isinstance(ours, list) and isinstance(theirs, list):
        return [*ours, *(x for x in theirs if x not in ours)], False
    return ours, True


def written(raw: str) -> dict[str, str]:
    """The lines of each top-level key of a text's frontmatter, as they are written."""
    m = FENCE.match(raw)
    out: dict[str, str] = {}
    last = None
    for line in m[1].splitlines() if m else []:
        if key := re.match(r"([^\s#\-][^:]*?)\s*:(?:\s|$)", line):
            last = key[1].strip("\"'")
            out[last] = line + "\n"
        elif last is not None:
            out[last] += line + "\n"
    return out


def merge_notes(base: str, ours: str, theirs: str) -> tuple[str, bool]:
    """Merge frontmatter key by key and the body by lines; what one side holds stays as it wrote it."""
    (bf, bb), (of, ob), (tf, tb) = (split_frontmatter(x) for x in (base, ours, theirs))
    mine, other = written(ours), written(theirs)
    head, clash = "", False
    for key in dict.fromkeys([*of, *tf, *bf]):
        value, clashes = merge_value(*(x.get(key, _GONE) for x in (bf, of, tf)))
        clash |= clashes
        if value is _GONE:
            continue
        side = mine if key in of and of[key] == value else other if key in tf and tf[key] == value else {}
        listed = f"[{', '.join(map(str, value))}]" if isinstance(value, list) else "" if value is None else value
        head += side.get(key, f"{key}: {listed}\n")
    body, broken = merge_lines(bb, ob, tb)
    return (f"---\n{head}---\n" if head else "") + body, clash or broken


def merge_rows(rows: DataFrame) -> DataFrame:
    """path, merged, conflict for rows (path, base, ours, theirs)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [merge_notes(b or "", o or "", t or "") for b, o, t in zip(part["base"], part["ours"], part["theirs"], strict=True)]
            yield pd.DataFrame({"path": part["path"], "merged": [d[0] for d in done], "conflict": [d[1] for d in done]})

    return rows.select("path", "base", "ours", "theirs").mapInPandas(run, "path string, merged string, conflict boolean")


def diff_rows(rows: DataFrame) -> DataFrame:
    """path, diff for rows (path, old, new)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "diff": [unified(a or "", b or "", p) for p, a, b in zip(part["path"], part["old"], part["new"], strict=True)]})

    return rows.select("path", "old", "new").mapInPandas(run, "path string, diff string")
