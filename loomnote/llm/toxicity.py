"""Toxicity by compression distance.

zstandard trains one dictionary on the windows of labelled ordinary texts and one on the
windows of labelled toxic texts.  A window of text is compressed with the ordinary
dictionary, and with the toxic one laid before it: what it gets shorter by is what toxic
text has in common with it and ordinary text has not.  Toxic documents are mostly made of
ordinary words, and so is their dictionary; ordinary windows that it shortens by chance
are trained into a third dictionary, which both sides share, so that they no longer tell.
All of that is done once for each third of the labelled documents left out, and how much
the windows of a left-out document are shortened is calibrated, with the threshold; a new
document is measured with each set of dictionaries, and the measures are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomnote.llm.bytetext import release
from loomnote.llm.shared import small_batches

#: The classifier is fitted on at most so many labelled documents a class, of at most so
#: many characters each; every text is scored whole.
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 20_000
WINDOW_BYTES = 100
#: Dictionaries are trained on at most so many windows, dealt evenly over the sampled ones.
SAMPLE_WINDOWS = 200_000
#: Ends all dictionaries and begins every window, so that each window compresses well
#: enough for zstandard to keep its matches, however short it is.
PREAMBLE = b"~0123456789=abcdefghijklmnop^QRSTUVWXYZ|"
ORDINARY_BYTES = 65_536
TOXIC_BYTES = 6_144
SHARED_BYTES = 16_384
#: Lengths, in bytes, of the pieces that training weighs and of those it takes.
DMER, PIECE = 8, 16
#: Rounds in which ordinary windows that the toxic dictionary shortens by two bytes are trained in.
ROUNDS = 2
#: Sets of dictionaries, each trained without its own share of the documents.
FOLDS = 3
#: A document's windows are counted by how many bytes they are shortened, from LEAST to MOST.
LEAST, MOST = -2, 13
#: A clean document above the threshold weighs so many times a toxic one below it.
CLEAN_WEIGHT = 1.5
#: A text's windows count as so many more, so that a few alone tell little.
DAMPED = 8
#: A text without words scores this.
EMPTY_SCORE = 0.01


@dataclass
class Dictionaries:
    """An ordinary and a toxic dictionary."""

    ordinary: bytes
    toxic: bytes

    def compressors(self) -> tuple:
        """For windows with the preamble: with the ordinary dictionary, and with the toxic one before it."""

        def one(content: bytes):
            held = zs.ZstdCompressionDict(content + PREAMBLE, dict_type=zs.DICT_TYPE_RAWCONTENT)
            settings = zs.ZstdCompressionParameters.from_level(5, min_match=4, strategy=zs.STRATEGY_LAZY2, window_log=17, hash_log=17, chain_log=17, write_content_size=False, write_dict_id=False)
            held.precompute_compress(compression_params=settings)
            return zs.ZstdCompressor(compression_params=settings, dict_data=held)

        return one(self.ordinary), one(self.toxic + self.ordinary)


@dataclass
class Model:
    """Sets of dictionaries, and a logistic scorer over how much a document's windows are shortened."""

    sets: list[Dictionaries]
    window: int = WINDOW_BYTES
    weights: np.ndarray = field(default_factory=lambda: np.zeros(MOST - LEAST + 3))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(MOST - LEAST + 2))
    scale: np.ndarray = field(default_factory=lambda: np.ones(MOST - LEAST + 2))

    def compressors(self) -> list[tuple]:
        return [s.compressors() for s in self.sets]


def lowered(text: str | None) -> str:
    return (text or "").lower()


def windows(data: bytes, size: int) -> list[bytes]:
    """Cut a text into windows of about `size` bytes, at blanks where there are any near."""
    out, at, n = [], 0, len(data)
    while n - at > size:
        cut = data.rfind(b" ", at + size // 2, at + size)
        cut = at + size if cut < 0 else cut
        out.append(data[at:cut])
        at = cut
    out.append(data[at:])
    return out


def shortened(cut: list[bytes], compressors: tuple) -> np.ndarray:
    """By how many bytes each window is shorter with the toxic dictionary."""
    ordinary, toxic = (c.compress for c in compressors)
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in map(PREAMBLE.__add__, cut)], np.int64)


def measure(text: str | None, window: int, compressors: list[tuple]) -> np.ndarray:
    """The scorer's inputs, averaged over the sets of dictionaries; zeros for a text without words.

    Logarithms of how many windows are shortened by LEAST, .. MOST - 1 bytes or more, less
    half of that of how many windows there are (damped), which is an input of its own, and the mean of bytes.
    """
    out = np.zeros((len(compressors), MOST - LEAST + 2))
    data = lowered(text).encode("utf-8", "replace")
    if data.strip():
        cut = windows(data, window)
        for row, pair in zip(out, compressors, strict=True):
            saved = shortened(cut, pair)
            counts = np.bincount(np.clip(saved, LEAST - 1, MOST - 1) - LEAST + 1, minlength=MOST - LEAST + 1)
            size = len(saved) + DAMPED
            row[:] = *(np.log1p(np.cumsum(counts[::-1])[::-1][1:]) - np.log(size) / 2), np.log(size), saved.sum() / size
    return out.mean(axis=0)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of the samples; where they are too few to train on, their end."""
    if len(samples) > SAMPLE_WINDOWS:
        samples = [samples[i] for i in np.linspace(0, len(samples) - 1, SAMPLE_WINDOWS).astype(int)]
    try:
        return zs.train_dictionary(size, samples, k=PIECE, d=DMER, level=3).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], window: int = WINDOW_BYTES) -> Dictionaries:
    """Dictionaries of the windows of each class, and of the ordinary ones that the toxic one shortens."""
    foul, clean = ([w for t in texts for w in windows(t, window)] for texts in (toxic, ordinary))
    plain = dictionary(clean, ORDINARY_BYTES)
    # of little text only what it repeats: the rest of its words are ordinary
    made, hard = Dictionaries(plain, dictionary(foul, min(TOXIC_BYTES, max(256, sum(map(len, foul)) // 10)))), []
    for _ in range(ROUNDS):
        hard += [w for w, saved in zip(clean, shortened(clean, made.compressors()), strict=True) if saved >= 2]
        made = Dictionaries(dictionary(hard, SHARED_BYTES) + plain, made.toxic)
    return made


def fit(toxic: list[str], ordinary: list[str], window: int = WINDOW_BYTES) -> Model:
    """Train a set of dictionaries without each fold of the documents, and calibrate on those left out."""
    toxic, ordinary = ([lowered(x) for x in texts] for texts in (toxic, ordinary))
    sets, rows, truth = [], [], []
    for fold in range(FOLDS):
        rest = ([t.encode("utf-8", "replace") for i, t in enumerate(texts) if i % FOLDS != fold] for texts in (toxic, ordinary))
        sets.append(dictionaries(*rest, window))
        pair = [sets[-1].compressors()]
        for label, texts in ((1, toxic[fold::FOLDS]), (0, ordinary[fold::FOLDS])):
            rows += [measure(t, window, pair) for t in texts]
            truth += [label] * len(texts)
    model = Model(sets, window)
    if not toxic or not ordinary:
        model.weights[0] = -4.0  # nothing to calibrate on: windows shortened by four bytes tell
        model.weights[1 + 4 - LEAST] = 4.0
        return model
    x, y = np.array(rows), np.array(truth)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    # what hardly differs in the sample must not weigh where it does, as in far longer texts
    least = np.array([0.5] * (x.shape[1] - 1) + [0.05])
    model.centre, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), least)
    z = np.hstack([np.ones((len(x), 1)), (x - model.centre) / model.scale])
    w = np.zeros(x.shape[1] + 1)
    ridge = np.array([1e-6] + [1.0] * x.shape[1])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + w * ridge
        hessian = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge)
        w -= np.linalg.solve(hessian, gradient)
    # the threshold of score 0.5 goes where most calibration documents fall on their side
    margin = z @ w
    cuts = np.unique(margin)
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts
    cuts = cuts[:: max(1, len(cuts) // 500)]
    weight = np.where(y == 1, weight, CLEAN_WEIGHT * weight)
    right = np.array([((margin > c) == (y == 1)) @ weight for c in cuts])
    best = np.flatnonzero(right >= right.max() - 1e-9)
    w[0] -= cuts[best[len(best) // 2]]
    model.weights = w
    return model


def score(rows: np.ndarray, model: Model) -> np.ndarray:
    """0 to 1; a text without words scores EMPTY_SCORE."""
    z = (rows - model.centre) / model.scale
    out = 1 / (1 + np.exp(-np.clip(model.weights[0] + z @ model.weights[1:], -30, 30)))
    return np.where(rows[:, -2] > 0, out, EMPTY_SCORE)


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 marks held-out rows.  A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5


def sample(documents: DataFrame, labels: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """Toxic and ordinary training texts: of each label the `docs` ids of lowest hash.  Null labels tell nothing.

    Held-out ids, texts of more than `chars` characters and rows with null id, label or
    text are not learned from.  Contradicting labels of one id count as toxic.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder() != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    picked = None
    for label in (1, 0):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs)
        picked = part if picked is None else picked.unionAll(part)
    ids = {r.doc_id: int(r.toxic) for r in picked.collect()}  # at most 2 * docs rows
    spark = documents.sparkSession
    rows = spark.createDataFrame(list(ids.items()) or [(None, None)], "doc_id long, toxic int").where("doc_id is not null")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= chars)
    found = texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    pairs = sorted((r.doc_id, r.toxic, r.text) for r in found.collect())  # as many, of bounded length
    return [t for _, y, t in pairs if y == 1], [t for _, y, t in pairs if y == 0]


def train(documents: DataFrame, labels: DataFrame) -> Model:
    return fit(*sample(documents, labels))


def classify(documents: DataFrame, model: Model) -> DataFrame:
    """Per document doc_id and score; every whole text is read, null counts as empty.

    Scores depend on the text alone; rows that share a doc_id, or have none, are scored
    one by one and other columns are ignored.  A very long text is read window by window;
    an empty table gives no rows.
    """
    spark: SparkSession = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        compressors = own.compressors()
        for batch in batches:
            rows = [measure(text.as_py(), own.window, compressors) for text in batch.column("text")]
            out = score(np.array(rows), own) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])
            release()

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def remove_toxic(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns, in one pass.

    Every row is judged by its own text: repeated rows go or stay together, a null doc_id
    changes nothing, and null or empty texts stay.
    """
    spark: SparkSession = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches):
        own = held.value
        compressors = own.compressors()
        for batch in batches:
            rows = [measure(text.as_py(), own.window, compressors) for text in batch.column(place)]
            if rows:
                yield batch.filter(pa.array(score(np.array(rows), own) < threshold))
            release()

    # numbered names: Spark's own hand-over does not take every column name
    plain = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)
