"""Keyword search, vector search, fusion and reranking, for many queries at once."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomnote.functions import text as T
from loomnote.operators import scoring
from loomnote.operators.order import cut

#: BM25, rank fusion and candidate window.
K1, B = 1.2, 0.75
FUSION_K, KEYWORD_WEIGHT, SEMANTIC_WEIGHT = 60, 1.0, 3.0
RERANKED = 50


def window_size(limit: int) -> int:
    """Candidates that each leg hands on."""
    return max(5 * limit, 50)


def top(rows: DataFrame, k: int, key: str = "query_id", score: str = "score", tie: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """The k best rows a query, ranked from 1; partial limits apply before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return rows.withColumn(rank, F.row_number().over(order).cast("long")).where(F.col(rank) <= k)


def bm25(chunks: DataFrame, queries: DataFrame, fields: tuple[str, ...] = ("text",), k: int | None = 10) -> DataFrame:
    """query_id, chunk_id, score (, rank): the k best chunks a query.

    queries: query_id, terms (, weights: a boost for each term).  Statistics are a field's
    own, over the chunks given.  The chunks are read once: their lengths and the counts of
    the queries' terms are kept, and scored as matrix products (`scoring`).
    """
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, score double"

    def one(block: pa.Table) -> DataFrame | None:
        terms = pa.array(sorted({t for ts in block.column("terms").to_pylist() for t in ts or [] if t is not None}), pa.string())
        if not len(terms):
            return None
        counted = cut(scoring.postings(chunks, fields, T.words, terms))
        each = [x for i in range(len(fields)) for x in (f"count_if(l{i} > 0) AS n{i}", f"avg(if(l{i} > 0, l{i}, null)) AS m{i}")]
        sizes = counted.selectExpr(*each).first()
        df = np.zeros((len(fields), len(terms)))
        for i in range(len(fields)):  # a row for each term asked, at most
            for r in counted.select(F.explode(f"t{i}").alias("t")).groupBy("t").count().collect():
                df[i, r.t] = r["count"]
        statistics = [(sizes[f"n{i}"], sizes[f"m{i}"] or 1.0, df[i]) for i in range(len(fields))]
        return scoring.weighed(counted, block, terms, statistics, K1, B, k, schema)

    total = scoring.over_blocks(queries.select("query_id", "terms", *(c for c in ("weights",) if c in queries.columns)), one, schema)
    return total if k is None else top(total, k)


_TOKEN = re.compile(
    r'''\s*(?:(?P<op>AND|OR|NOT|&&|\|\|)(?=[\s()]|$)|(?P<close>\))(?:\^(?P<boosted>\d+(?:\.\d+)?))?
    |(?P<sign>[+\-!])?(?:(?P<field>\w+):)?(?:(?P<open>\()|(?P<phrase>"[^"]*")(?:~(?P<slop>\d+))?|[\[{](?P<low>\S+)\s+TO\s+(?P<high>[^\s\]}]+)[\]}]|/(?P<regex>(?:[^/\\]|\\.)+)/|(?P<word>[^\s()"^]+))(?:\^(?P<boost>\d+(?:\.\d+)?))?)''',
    re.X,
)
_OPERATOR = {"AND": "must", "&&": "must", "OR": "should", "||": "should", "NOT": "must_not"}


def parse_query(query: str) -> list[dict]:
    """A query's clauses: kind (term, prefix, fuzzy, phrase, range, regex, group, all), field, text, boost, occur.

    Understands field:, "phrases" and "phrases"~slop, trailing * and ~, [a TO b], /regular expressions/, ^boost,
    ( ) and + - ! AND OR NOT.  A group has `clauses`, a range `low` and `high`.  What does not
    parse is taken as plain words.
    """
    stack: list[list[dict]] = [[]]
    waiting, at, text = ["should"], 0, query.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or (m["close"] and len(stack) == 1):
            return _plain(query)
        at, own = m.end(), stack[-1]
        if m["op"]:
            if m["op"] in ("AND", "&&") and own and own[-1]["occur"] == "should":
                own[-1]["occur"] = "must"
            waiting[-1] = _OPERATOR[m["op"]] if waiting[-1] != "must" or m["op"] != "NOT" else "must_not"
            continue
        if m["close"]:
            stack.pop(), waiting.pop()
            stack[-1][-1]["boost"] = float(m["boosted"] or 1)
            continue
        occur = {"+": "must", "-": "must_not", "!": "must_not"}.get(m["sign"], waiting[-1])
        waiting[-1] = "should"
        clause = {"kind": "term", "field": m["field"], "text": "", "boost": float(m["boost"] or 1), "occur": occur}
        own.append(clause)
        if m["open"]:
            clause |= {"kind": "group", "clauses": []}
            stack.append(clause["clauses"]), waiting.append("should")
        elif m["phrase"] is not None:
            clause |= {"kind": "phrase", "text": m["phrase"][1:-1].lower(), "slop": int(m["slop"] or 0)}
        elif m["low"]:
            clause |= {"kind": "range", "low": m["low"].lower(), "high": m["high"].lower()}
        elif m["regex"]:
            clause |= {"kind": "regex", "text": m["regex"].lower()}
        elif m["word"] == "*":
            clause["kind"] = "all"
        elif m["word"].endswith("*"):
            clause |= {"kind": "prefix", "text": m["word"][:-1].lower()}
        elif f := re.fullmatch(r"(.+)~(\d?)", m["word"]):
            clause |= {"kind": "fuzzy", "text": f[1].lower()}
        else:
            clause["text"] = m["word"].lower()
    return stack[0] if len(stack) == 1 else _plain(query)


def _plain(query: str) -> list[dict]:
    return [{"kind": "term", "field": None, "text": w, "boost": 1.0, "occur": "should"} for w in re.findall(r"\w+", query.lower())]


def leaves(clauses: list[dict], boost: float = 1.0, field: str | None = None) -> Iterator[dict]:
    """The clauses that can add to a score, out of their groups, with the product of their boosts."""
    for c in clauses:
        if c["occur"] == "must_not":
            continue
        own = {**c, "boost": c["boost"] * boost, "field": c["field"] or field}
        if c["kind"] == "group":
            yield from leaves(c["clauses"], own["boost"], own["field"])
        else:
            yield own


def phrase_words(text: str) -> list[str]:
    """A phrase's words, as the analyser has them."""
    return re.findall(r"[^\W_]+", text.lower())


def sloppy_frequency(places: Column, slots: int, slop: int) -> Column:
    """How often all of a phrase's words stand together, from places (pos less the word's place in the phrase, slot).

    The shortest stretches with one place of each slot count, 1 / (1 + their length), if that
    is `slop` at most; 0 for words that stand as in the phrase.
    """
    last = F.lit(2**31 - 1)
    events = F.concat(F.array_sort(places), F.array(F.struct(last.alias("pos"), F.lit(-1).alias("slot"))))
    start = F.struct(F.array_repeat(F.lit(None).cast("int"), slots).alias("held"), last.alias("at"), F.lit(-(2**31)).alias("seen"), F.lit(0.0).alias("f"))

    def step(state: Column, event: Column) -> Column:
        # a place's words are all held before the stretch that ends there is looked at
        low = F.array_min(state["held"])
        ends = (event["pos"] > state["at"]) & F.forall(state["held"], lambda x: x.isNotNull()) & (low > state["seen"])
        width = state["at"] - low
        more = F.when(ends & (width <= slop), 1 / (1 + width)).otherwise(0.0)
        held = F.transform(state["held"], lambda x, i: F.when(i == event["slot"], event["pos"]).otherwise(x))
        return F.struct(held.alias("held"), event["pos"].alias("at"), F.when(ends, low).otherwise(state["seen"]).alias("seen"), (state["f"] + more).alias("f"))

    return F.aggregate(events, start, step, lambda state: state["f"])


def phrase_frequency(tokens: Column, words: list[str], slop: int) -> Column:
    """`sloppy_frequency` of words among tokens."""
    def of(slot: int, word: str) -> Column:
        every = F.transform(tokens, lambda t, i: F.when(t == word, F.struct((i - slot).alias("pos"), F.lit(slot).alias("slot"))))
        return F.filter(every, lambda x: x.isNotNull())

    places = [of(slot, word) for slot, word in enumerate(words)]
    return sloppy_frequency(F.concat(*places), len(words), slop)


def clause_matches(clause: dict, tokens: Column) -> Column:
    """Whether a clause matches a chunk's words."""
    kind, text = clause["kind"], clause["text"]
    if kind == "all":
        return F.lit(True)
    if kind == "prefix":
        return F.exists(tokens, lambda t: t.startswith(text))
    if kind == "fuzzy":
        return F.exists(tokens, lambda t: F.levenshtein(t, F.lit(text), 2) >= 0)
    if kind == "range":
        low, high = clause["low"], clause["high"]
        return F.exists(tokens, lambda t: (F.lit(True) if low == "*" else t >= low) & (F.lit(True) if high == "*" else t <= high))
    if kind == "regex":
        return F.exists(tokens, lambda t: t.rlike(f"^(?:{text})$"))
    if kind == "phrase" or not text.isalnum():  # a word that the analyser splits is a phrase of its parts
        if clause.get("slop") and len(phrase_words(text)) > 1:
            return phrase_frequency(tokens, phrase_words(text), clause["slop"]) > 0
        joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        return F.contains(joined, F.concat(F.lit(" "), T.normalised(F.lit(text)), F.lit(" ")))
    return F.array_contains(tokens, text)


def _hits(clause: dict, fields: tuple[str, ...]) -> Column:
    own = (clause["field"],) if clause["field"] else fields
    if clause["kind"] == "group":
        return selects(clause["clauses"], own)
    hit = F.lit(False)
    for name in own:
        hit |= clause_matches(clause, T.words(F.col(name)))
    return hit


def selects(clauses: list[dict], fields: tuple[str, ...] = ("text", "heading")) -> Column:
    """All `must`, no `must_not`, and one `should` at least where nothing is required."""
    out, should, required = F.lit(True), None, False
    for clause in clauses:
        hit = _hits(clause, fields)
        if clause["occur"] == "must":
            out, required = out & hit, True
        elif clause["occur"] == "must_not":
            out &= ~hit
        else:
            should = hit if should is None else should | hit
    return out if should is None or required else out & should


def matching(chunks: DataFrame, query: str, fields: tuple[str, ...] = ("text", "heading")) -> DataFrame:
    """The chunks that a query in the small syntax selects."""
    return chunks.where(selects(parse_query(query), fields))


def scored_syntax(chunks: DataFrame, query: str, fields: tuple[str, ...] = ("text", "heading")) -> DataFrame:
    """query_id (0), chunk_id, score: the chunks that a query selects.

    Words score by BM25, times their boosts, and so does a phrase, as one word whose idf is the
    sum of its words'; a prefix, fuzzy word, range, regular expression or * that matches adds
    its boost.
    """
    parts = list(leaves(parse_query(query)))
    rows, spark = chunks.where(selects(parse_query(query), fields)), chunks.sparkSession
    total = F.lit(0.0)
    weights: dict[str, dict[str, float]] = {}
    for c in parts:
        own, words = (c["field"],) if c["field"] else fields, phrase_words(c["text"])
        if c["kind"] not in ("term", "phrase"):
            total += F.when(_hits(c, fields), F.lit(c["boost"])).otherwise(0.0)
        elif len(words) > 1:
            for name in own:
                total += c["boost"] * _phrase_score(chunks, name, words, c.get("slop", 0))
        else:
            for name in own:
                for w in words:
                    weights.setdefault(name, {})[w] = max(weights.get(name, {}).get(w, 0.0), c["boost"])
    out = rows.select("chunk_id", total.alias("extra"))
    for n, (name, own) in enumerate(weights.items()):
        asked = spark.createDataFrame([(0, list(own), list(own.values()))], "query_id int, terms array<string>, weights array<double>")
        out = out.join(bm25(chunks, asked, (name,), None).select("chunk_id", F.col("score").alias(f"s{n}")), "chunk_id", "left")
    total = F.col("extra")
    for n in range(len(weights)):
        total += F.coalesce(f"s{n}", F.lit(0.0))
    return out.select(F.lit(0).alias("query_id"), "chunk_id", F.round(total, 6).alias("score"))


def _phrase_score(chunks: DataFrame, field: str, words: list[str], slop: int) -> Column:
    """BM25 of a phrase in a field, from sums over all chunks."""
    tokens = T.words(F.col(field))
    each = [F.count_if(F.array_contains(tokens, w)).alias(f"d{i}") for i, w in enumerate(words)]
    sums = chunks.agg(F.count_if(F.size(tokens) > 0).alias("n"), F.avg(F.when(F.size(tokens) > 0, F.size(tokens))).alias("mean"), *each).first()
    idf = sum(math.log(1 + (sums.n - sums[f"d{i}"] + 0.5) / (sums[f"d{i}"] + 0.5)) for i in range(len(words)))
    f = phrase_frequency(tokens, words, slop)
    return F.lit(idf) * f / (f + K1 * (1 - B + B * F.size(tokens) / F.lit(sums["mean"] or 1.0)))


def semantic_degraded(mode: str, query: str, embedder: bool, vector: bool) -> bool:
    """Whether a search that wants vectors of a vault that has them goes without: no query vector could be had."""
    return bool(query.strip()) and mode != "KEYWORD" and embedder and not vector


def grep(notes: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = False, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """path, line (from 1), text: matching lines outside private spans, trimmed to 240 characters."""
    from loomnote.operators.filters import DRAFTS, SESSIONS

    rows = notes.where(~F.col("path").startswith(SESSIONS))
    if prefix:
        rows = rows.where(F.col("path").startswith(prefix))
    if not (prefix or "").startswith(DRAFTS):
        rows = rows.where(~F.col("path").startswith(DRAFTS))
    lines = rows.select("path", F.posexplode(F.split(T.masked_private(F.col("text")), r"\r\n|\n|\r")).alias("at", "line"))
    if literal:
        hit = F.contains(F.lower("line"), F.lit(pattern.lower())) if ignore_case else F.contains(F.col("line"), F.lit(pattern))
    else:
        hit = F.col("line").rlike(("(?iu)" if ignore_case else "") + pattern)
    found = lines.where(hit).select("path", (F.col("at") + 1).cast("long").alias("line"), F.substring(F.trim("line"), 1, 240).alias("text"))
    return found if limit is None else found.orderBy("path", "line").limit(limit)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, chunk_id, score (1 + cosine) / 2: exact, over vectors (chunk_id, vec), queries (query_id, vec).

    The stated queries meet all rows, as matrix products; rows that the caller filters out
    before are never scored.  A task hands on k rows a query.
    """
    return top(scoring.cosines(vectors, queries, k), k)


def fuse(keyword: DataFrame, semantic: DataFrame, keyword_weight: float = KEYWORD_WEIGHT, semantic_weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """Reciprocal rank fusion of two ranked legs (query_id, chunk_id, rank)."""
    legs = keyword.select("query_id", "chunk_id", "rank", F.lit(keyword_weight).alias("w"), F.lit(True).alias("kw")).unionAll(semantic.select("query_id", "chunk_id", "rank", F.lit(semantic_weight).alias("w"), F.lit(False).alias("kw")))
    return legs.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") / (FUSION_K + F.col("rank"))), 9).alias("score"), F.max("kw").alias("matched_keyword"), F.max(~F.col("kw")).alias("matched_semantic"))


def search(mode: str, chunks: DataFrame, vectors: DataFrame | None, queries: DataFrame, limit: int = 10) -> DataFrame:
    """KEYWORD, SEMANTIC or HYBRID; without vectors every mode is a keyword search."""
    if mode == "KEYWORD" or vectors is None:
        return bm25(chunks, queries, ("text", "heading"), limit)
    if mode == "SEMANTIC":
        return knn(vectors, queries, limit)
    wide = window_size(limit)
    return top(fuse(bm25(chunks, queries, ("text", "heading"), wide), knn(vectors, queries, wide)), limit)


def rerank(ranked: DataFrame, score: Column, head: int = RERANKED) -> DataFrame:
    """Rescore the first `head` rows a query; the rest follow in their old order and score."""
    rows = ranked.withColumn("in_head", F.col("rank") <= head).withColumn("new", F.when(F.col("rank") <= head, score))
    order = Window.partitionBy("query_id").orderBy(F.desc("in_head"), F.desc_nulls_last("new"), "rank", "chunk_id")
    return rows.select("query_id", "chunk_id", "in_head", F.coalesce("new", "score").alias("score"), F.row_number().over(order).cast("long").alias("rank"), F.col("new").isNull().alias("missed"))


def reranked(ranked: DataFrame, score: Column, head: int = RERANKED) -> DataFrame:
    """query_id, chunk_id, in_head, score, rank after `rerank`."""
    return rerank(ranked, score, head).drop("missed")


def rerank_with(ranked: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], head: int = RERANKED) -> DataFrame:
    """Rerank by a pluggable scorer of (query, text) batches.

    A scorer that fails keeps the order, and `degraded` says so of a query's rows.
    """

    @pandas_udf("double")
    def scored(query: pd.Series, text: pd.Series) -> pd.Series:
        try:
            return pd.Series(scorer(query, text), dtype="float64")
        except Exception:  # the contract: degraded, not failed
            return pd.Series([None] * len(query), dtype="float64")

    rows = rerank(ranked, scored(F.col("query"), F.col("text")), head)
    unscored = F.max((F.col("in_head") & F.col("missed")).cast("int")).over(Window.partitionBy("query_id")) == 1
    return rows.withColumn("degraded", unscored).drop("missed")


def passages(chunks: DataFrame, prefix: str = "") -> DataFrame:
    """The chunks with the text that is embedded: the model's passage prefix, the heading if any, the text."""
    head = F.when(F.coalesce("heading", F.lit("")) == "", F.lit("")).otherwise(F.concat("heading", F.lit("\n")))
    return chunks.withColumn("passage", F.concat(F.lit(prefix), head, "text"))


def embed_with(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32, prefix: str = "") -> DataFrame:
    """Adds vec and error; a batch that fails is tried again text by text.

    `prefix` goes before every text, as some models want ("query: ", "passage: ").
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            vectors, errors = [], []
            texts = [prefix + t for t in part["text"].fillna("")]
            for i in range(0, len(texts), batch):
                try:
                    got = embed(texts[i : i + batch])
                    vectors += got
                    errors += [None] * len(got)
                except Exception:
                    for text in texts[i : i + batch]:
                        try:
                            vectors.append(embed([text])[0])
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(str(e))
            yield part.assign(vec=vectors, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, vec array<float>, error string")


def bag_of_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """A deterministic embedder without a model: hashed words, length one."""
    import math
    import re
    import zlib

    out = []
    for text in texts:
        v = [0.0] * size
        for w in re.findall(r"\w+", text.lower()):
            v[zlib.crc32(w.encode()) % size] += 1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def federated(hits: DataFrame, limit: int = 10) -> DataFrame:
    """Hits (vault, query_id, chunk_id, score) of several vaults merged by raw score.

    Each vault hands on its own best first, so the merge reads `limit` rows a vault.
    """
    own = Window.partitionBy("vault", "query_id").orderBy(F.desc("score"), "chunk_id")
    best = hits.withColumn("place", F.row_number().over(own)).where(F.col("place") <= limit).drop("place")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vault", "chunk_id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def mean_vectors(chunks: DataFrame) -> DataFrame:
    """path, vec: the mean of a note's distinct chunks (by content_hash; of several vectors the smallest), length one; zero: none."""
    once = chunks.where("vec is not null").groupBy("path", "content_hash").agg(F.min("vec").alias("vec"))
    each = once.select("path", F.posexplode("vec").alias("i", "x")).groupBy("path", "i").agg(F.avg("x").alias("m"))
    means = each.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("parts")).select("path", F.transform("parts", lambda p: p["m"]).alias("mean"))
    norm = F.sqrt(T.dot(F.col("mean"), F.col("mean")))
    return means.withColumn("norm", norm).where("norm > 0").select("path", F.transform("mean", lambda x: x / F.col("norm")).alias("vec"))


def reuse_vectors(chunks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose content has a vector already, and those that need one."""
    keyed = known.select("content_hash", "vec").dropDuplicates(["content_hash"])
    return chunks.join(keyed, "content_hash"), chunks.join(keyed.select("content_hash"), "content_hash", "left_anti")


def retrieval_metrics(ranked: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """recall, ndcg and mrr at k, averaged over the queries of gains (query_id, item, gain > 0)."""
    dcg = (F.pow(F.lit(2.0), F.col("gain")) - 1) / F.log2(F.col("place") + 1)
    best = gains.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "item")))
    ideal = best.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, dcg)).alias("ideal"), F.count("item").alias("wanted"))
    hits = ranked.where(F.col("rank") <= k).withColumnRenamed("rank", "place").join(gains, ["query_id", "item"])
    got = hits.groupBy("query_id").agg(F.sum(dcg).alias("dcg"), F.count("item").alias("found"), F.min("place").alias("first"))
    each = ideal.join(got, "query_id", "left").select((F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"), (F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))
    return each.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("rr"), 6).alias("mrr"))


def cached_embedder(embed: Callable[[list[str]], list[list[float]]], size: int = 256) -> Callable[[str], list[float]]:
    """An embedder of single queries that remembers the last `size`; callers get copies."""
    from functools import lru_cache

    @lru_cache(maxsize=size)
    def known(text: str) -> tuple[float, ...]:
        return tuple(embed([text])[0])

    return lambda text: list(known(text))


def embedding_progress(chunks: DataFrame, started: float, now: float) -> DataFrame:
    """One row: done, total, rate a second, seconds left (null: no rate yet)."""
    counts = chunks.agg(F.count_if(F.col("vec").isNotNull()).alias("done"), F.count("*").alias("total"))
    rate = F.col("done") / F.lit(max(now - started, 1e-9))
    return counts.withColumn("rate", F.round(rate, 3)).withColumn("left", F.when(rate > 0, F.round((F.col("total") - F.col("done")) / rate, 1)))
