"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm import ann, bpe, decontaminate, divergence, language, linededup, minhash, passages, quality, runs, secrets, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    """The rank file that op1 and the pipeline use; the operator itself takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to byte-level BPE ids and decoded again, as digests."""
    return bpe.round_trip(spark, table(spark, sf_dir, "documents"), ranks_path())


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of five-word runs are at least 0.75 similar."""
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document, judged by a random forest."""
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), model)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by weak labels and a hashed linear scorer."""
    return quality.assess(spark, table(spark, sf_dir, "documents"))


#: (verdict, host, path): a rule fits its host and all subdomains where the path starts so.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the given rules, else by rules mined from labels."""
    pages = table(spark, sf_dir, "pages")
    learned = urlfilter.mine(urlfilter.labelled_urls(pages, table(spark, sf_dir, "labels")))
    return urlfilter.judge(pages, URL_RULES, learned)


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector, by cosine."""
    return ann.search(spark, table(spark, sf_dir, "embeddings"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark, in runs of ten words."""
    found = decontaminate.scan(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that equal an earlier line or are one edit away from it."""
    left = linededup.dedup_lines(spark, table(spark, sf_dir, "documents"))
    lines, removed = left.columns[-2:]
    return left.select("doc_id", F.col(lines).alias("n_lines"), F.col(removed).alias("n_removed"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of thirteen-word runs that a smaller doc_id has."""
    left = passages.remove_repeats(spark, table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by compression distance, learned without the held-out fifth."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.classify(documents, model)
    return scored.select("doc_id", (toxicity.remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, with digests of all runs and of what is left."""
    return runs.audit(spark, table(spark, sf_dir, "documents"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under an n-gram model learned without the held-out seventh."""
    return language.assess(spark, table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of every source differ from each other source's and from its language's."""
    return divergence.audit(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_minhash": op2_minhash,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_url_filter": op5_url_filter,
    "op6_ann": op6_ann,
    "op7_decontaminate": op7_decontaminate,
    "op8_lines": op8_lines,
    "op9_passages": op9_passages,
    "op10_toxicity": op10_toxicity,
    "op11_runs": op11_runs,
    "op12_language": op12_language,
    "op13_divergence": op13_divergence,
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SMALL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LETTERS = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
_NON_SPACE = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {
    "op2_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_SMALL}, {_NON_SPACE}) AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.c >= 75 * (x.n + y.n - c.c)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op7_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_SMALL}, {_PLAIN}) AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_SMALL}, {_PLAIN}) AS w FROM benchmark),
 k AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS key FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 p AS (SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS key FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) AS i FROM d, (SELECT DISTINCT size FROM k))),
 h AS (SELECT p.doc_id, p.i, p.size, k.item_id FROM p JOIN k ON k.key = p.key AND k.size = p.size),
 x AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY doc_id),
 y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
 SELECT d.doc_id, len(d.w) AS n_words, coalesce(x.n_hit, 0) AS n_hit, coalesce(y.n_items, 0) AS n_items, sha256(coalesce(y.items, '')) AS items_sha256, coalesce(x.n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id""",
    "op9_passages": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_NON_SPACE}) AS w FROM documents),
 p AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 12), ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS i FROM d)),
 g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS lo FROM p) WHERE lo < doc_id),
 w AS (SELECT doc_id, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d)),
 k AS (SELECT w.doc_id, count(g.pos) AS n_removed, string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL) AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY w.doc_id)
 SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op13_divergence": f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_SMALL} AS t FROM documents),
 w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, {_LETTERS})) AS term FROM d),
 k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
 l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
 c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
 x AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
 g AS (SELECT s.lang, s.source, coalesce(x.n, 0) + coalesce(l.v, 0) AS t FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN x ON x.lang = s.lang AND x.source = s.source LEFT JOIN l ON l.lang = s.lang),
 p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // g.t AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (l.n + l.v) AS q FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 y AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS v FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(y.v, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN y ON y.lang = a.lang AND y.source = a.source AND y.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
 SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z) WHERE part = 'pair' OR rank <= 200""",
}
