"""Secrets by rule and line, as a write refuses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules by name.  None repeats a group: such patterns recurse, and a long line would end the JVM.
RULES = {
    "aws-access-key": r"\bAKIA[0-9A-Z]{16}\b",
    "assignment": r"(?i)(password|passwd|secret|token|api_?key)[\"']?\s*[=:]\s*[\"']?[^\s\"']{8,}",
    "private-key": r"-----BEGIN (?![A-Z ]*  )(?! )[A-Z ]*(?<= )PRIVATE KEY-----",
    "github-token": r"\bgh[pousr]_[0-9A-Za-z]{36,}",
    "slack-token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "google-key": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
}


def holds_secret(text: Column) -> Column:
    found = F.lit(False)
    for pattern in RULES.values():
        found |= F.coalesce(text.rlike(pattern), F.lit(False))
    return found


def findings(documents: DataFrame) -> DataFrame:
    """doc_id, rule, line (from 1): every line that a rule finds something in."""
    lines = documents.where(holds_secret(F.col("text"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hits = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.lit(n)) for n, p in RULES.items())), lambda r: r.isNotNull())
    return lines.select("doc_id", F.explode(hits).alias("rule"), (F.col("at") + 1).cast("long").alias("line"))
