"""URL filters: given rules first, then association rules mined from labelled URLs.

DataFrame, SQL and ML functions only.  A URL becomes a set of tokens.  Tokens that stand in
the same labelled URLs tell one fact and are mined as one item.  FP-growth finds
combinations of facts that go with the label `block`; those with enough support, lift and
a lower bound of their confidence are rules.  Given rules are looked up by each suffix of
a URL's host; mined ones through an inverted index, a join on each rule's rarest token.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule's URLs: this share of the labelled ones, and this many, at least.
MIN_SUPPORT = 0.002
MIN_COUNT = 20
#: The least that confidence may be, with 95 % certainty (Wilson's lower bound).
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
#: So many rules are broadcast; more are shuffled.
FEW_RULES = 20_000
BLOCK = "label:block"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """A host and its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def tokens(url: Column) -> Column:
    """The set of a URL's tokens: host and parent domains, path segments, query keys, fragment.

    Segments of digits count as one kind of segment.  A domain holds its parents' names, so
    each is one token; its labels alone are none.
    """
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    found = F.concat(
        F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(suffixes(host), lambda s: F.concat(F.lit("d:"), s))),
        F.transform(segments, lambda s: F.when(s.rlike(r"^\d+(\.\w+)?$"), F.concat(F.lit("p:#"), F.regexp_extract(s, r"(\.\w+)$", 1))).otherwise(F.concat(F.lit("p:"), s))),
        F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), F.substring_index(s, "=", 1))),
        F.when(F.instr(F.coalesce(url, F.lit("")), "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(found)


def lower_bound(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Wilson's lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def facts(labelled: DataFrame, least: float) -> DataFrame:
    """fact, members, goes: tokens of enough rows, those of the same rows as one; labelled: row, n, block, tokens."""
    each = labelled.select("row", "n", "block", F.explode("tokens").alias("token"))
    weight = F.when(F.col("block"), F.col("n")).otherwise(F.lit(0))
    known = each.groupBy("token").agg(F.sum("n").alias("all"), F.sum(weight).alias("hits"), F.bit_xor("row").alias("mark"), F.sum(F.pmod("row", F.lit(1 << 30))).alias("sum"))
    same = known.where(F.col("all") >= least).groupBy("all", "hits", "mark", "sum")
    return same.agg(F.min("token").alias("fact"), F.sort_array(F.collect_set("token")).alias("members")).select("fact", "members", "hits", "all")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_count: int = MIN_COUNT) -> list[tuple[list[str], float, float]]:
    """Rules (tokens, confidence, support) that predict `block`, from rows (url, block boolean).

    All labelled rows count, repeated ones as often as they stand; rows with a null url or
    label do not.  A rule is dropped if a rule over some of its tokens is as confident.
    Support bounds how many rules there can be, whatever the number of rows.  All facts of a
    URL are mined but those that no rule beside their own can hold: facts that stand in too
    few blocked rows, and facts that are rules by themselves and never fail, since whatever
    holds one of those is no more confident.
    """
    rows = labelled.where("url is not null and block is not null").groupBy("url", "block").agg(F.count("*").alias("n"))
    rows = rows.select(F.xxhash64("url", "block").alias("row"), "n", "block", tokens(F.col("url")).alias("tokens"))
    total, blocked = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("block"), F.col("n"))), F.lit(0))).first()
    if not blocked:
        return []
    least = max(min_support * total, min_count)
    known = facts(rows, least).where(F.col("hits") >= least)
    sure = (F.col("hits") == F.col("all")) & (F.lit(total / blocked) >= min_lift) & (lower_bound(F.col("hits"), F.col("all")) >= min_confidence)
    own = rows.select("row", "n", "block", F.explode("tokens").alias("fact")).join(known.where(~sure), "fact")
    baskets = own.groupBy("row", "block").agg(F.min("n").alias("n"), F.sort_array(F.collect_list("fact")).alias("items"))
    # rows without any fact count in the support of the rest
    missing = rows.select("row", "block", "n").join(baskets.select("row"), "row", "left_anti").withColumn("items", F.array().cast("array<string>"))
    baskets = baskets.unionByName(missing).select(F.when(F.col("block"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("items")
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=min_confidence, numPartitions=parts).fit(baskets)
    joint = F.col("support") * total
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK) & (F.col("lift") >= min_lift) & (lower_bound(joint, joint / F.col("confidence")) >= min_confidence))
    told = known.select("*", sure.alias("sure")).collect()  # at most the tokens of `least` rows each
    members = {r.fact: r.members for r in told}
    alone = [(r.members, 1.0, r.hits / total) for r in told if r.sure]
    found = sorted([*alone, *((sorted({t for f in r.antecedent for t in members[f]}), r.confidence, r.support) for r in rules.collect())], key=lambda r: (len(r[0]), -r[1], r[0]))
    kept: list[tuple[list[str], float, float]] = []
    for items, confidence, support in found:
        if not any(set(k) <= set(items) and c >= confidence for k, c, _ in kept):
            kept.append((items, confidence, support))
    return kept


def _constant(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), schema)


def rule_index(rules: list[tuple[str, str, str]]) -> Column:
    """Given rules (verdict, host, path) by host."""
    by: dict[str, list[dict]] = {}
    for verdict, host, path in rules:
        by.setdefault(host, []).append({"path": path, "rule": host + path, "verdict": verdict})
    return _constant(by, "map<string, array<struct<path: string, rule: string, verdict: string>>>")


def given(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest given rule that fits (equal lengths: the smaller text), or null."""
    index = rule_index(rules)
    found = F.flatten(F.transform(suffixes(host), lambda s: F.coalesce(index[s], F.array().cast("array<struct<path: string, rule: string, verdict: string>>"))))
    fits = F.filter(found, lambda r: path.startswith(r["path"]))
    ranked = F.array_sort(F.transform(fits, lambda r: F.struct((-F.length(r["rule"])).alias("order"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return F.get(ranked, F.lit(0))


def matched(urls: DataFrame, rules: list[tuple[list[str], float, float]]) -> DataFrame:
    """The distinct ones of `urls` (url, tokens) that have all tokens of some mined rule."""
    count: dict[str, int] = {}
    for items, _, _ in rules:
        for t in items:
            count[t] = count.get(t, 0) + 1
    heads = [min(items, key=lambda t: (count[t], t)) for items, _, _ in rules]
    rows = [{"token": h, "rest": [t for t in items if t != h]} for h, (items, _, _) in zip(heads, rules, strict=True)]
    index = urls.sparkSession.range(1).select(F.inline(_constant(rows, "array<struct<token: string, rest: array<string>>>")))
    index = F.broadcast(index) if len(rows) <= FEW_RULES else index
    each = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return each.where(F.size(F.array_except("rest", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], learned: list[tuple[list[str], float, float]]) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    A null URL, or one without `://`, has an empty host and path, which no rule fits
    unless its own host is empty.  Rows that share a page_id are judged one by one; a null
    page_id is kept; other columns are ignored; an empty table gives no rows.
    """
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    told = parts.withColumn("told", given(F.col("host"), F.col("path"), rules))
    if learned:
        open_urls = told.where("told is null").select("url", tokens(F.col("url")).alias("tokens"))
        hits = matched(open_urls, learned).select(F.col("url").alias("hit"))
        told = told.join(hits, (F.col("url") == F.col("hit")) & F.col("told").isNull(), "left")
    else:
        told = told.withColumn("hit", F.lit(None).cast("string"))
    method = F.when(F.col("hit").isNotNull(), "block").otherwise("allow")
    return told.select("page_id", "host", "path", F.col("told.rule").alias("rule"), F.coalesce(F.col("told.verdict"), method).alias("verdict"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, block: URLs whose last number names a labelled document; block: of low quality or toxic.

    Null URLs and ids are left out; contradicting labels of one id count as block.
    """
    number = F.expr(r"try_cast(regexp_extract(url, '/([0-9]{1,18})(?:[./?#].*)?$', 1) as bigint)")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__doc")).agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("block"))
    urls = pages.select(F.col("url").cast("string").alias("url")).select("url", number.alias("__doc")).where("__doc is not null")
    return urls.join(known, "__doc").select("url", "block")
