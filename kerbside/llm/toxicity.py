"""Toxicity by compression distance.

Zstandard dictionaries of equal size are trained on toxic and on ordinary text;
what a window of a text gains under the toxic one tells its wording. A third and
fourth are a larger one of ordinary text, without and with what toxic texts say
much more often than ordinary ones: a window that the fourth compresses better
holds such matter. Counts of these windows over several margins and both gains
become a probability by a logistic regression fitted on documents that no
dictionary was trained on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kerbside.llm.common import prepare_workers, whole_text

# The bounded sample of labelled rows: so many of each label, by a hash of the
# id, and of these the texts up to a length. Nothing else is bounded.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_CHARS = 2_000, 4_000, 20_000
WINDOW_BYTES = 40
LEVEL = 2
INDEX_STEP, LEAST_MATCH = 3, 5  # fixed values: of zstandard at this level
ORDINARY_BYTES = 110_000
GRAMS = (5, 6, 7, 8)  # bytes, about a word's stem
GRAM_SHARE, GRAM_RATIO, GRAM_DOCS = 0.025, 10.0, 4
MARGINS = (2, 3, 4, 5, 6, 8)
THRESHOLD = 0.3


def windows(text: str) -> list[bytes]:
    """Runs of whole words of at least ``WINDOW_BYTES``; at least one per text."""
    out, current, size = [], [], 0
    for word in text.lower().encode().split():
        current.append(word)
        size += len(word) + 1
        if size >= WINDOW_BYTES:
            out.append(b" " + b" ".join(current) + b" ")
            current, size = [], 0
    if current or not out:
        out.append(b" " + b" ".join(current) + b" ")
    return out


def _words(text: str) -> set[bytes]:
    return {b" " + w.strip(".,;:!?").encode() + b" " for w in set(text.lower().split())}


def _grams(word: bytes) -> list[tuple[int, bytes]]:
    return [(i, word[i : i + n]) for n in GRAMS for i in range(len(word) - n + 1)]


def at_every_step(stretch: bytes) -> bytes:
    """A short stretch so often that it begins at each of the compressor's steps.

    Of a dictionary the fast levels index every third byte, the others only where
    nothing else is; a match of a short stretch may begin at none of them. Longer
    ones have one in any case. The line breaks between them are in no window.
    """
    if len(stretch) >= LEAST_MATCH + INDEX_STEP - 1:
        return stretch
    apart = b"\n" * ((-len(stretch)) % INDEX_STEP + 1)
    return (stretch + apart) * INDEX_STEP


def telling_content(toxic: list[str], ordinary: list[str]) -> bytes:
    """What to add for the toxic dictionary: the stretches of words whose grams
    are in many toxic documents and in far fewer ordinary ones, commonest last."""
    seen = [Counter(), Counter()]
    words = [[_words(t) for t in texts] for texts in (ordinary, toxic)]
    for counts, docs in zip(seen, words):
        for doc in docs:
            counts.update({g for w in doc for _, g in _grams(w)})
    n_ordinary, n_toxic = max(1, len(ordinary)), max(1, len(toxic))
    least = max(GRAM_DOCS, GRAM_SHARE * n_toxic)
    telling = {
        g: n for g, n in seen[1].items()
        if n >= least and n / n_toxic >= GRAM_RATIO * (seen[0][g] + 1) / n_ordinary
    }
    stretches: Counter = Counter()
    for doc in words[1]:
        for word in doc:
            grams = _grams(word)
            best = max((telling.get(g, 0) for _, g in grams), default=0)
            if best:
                near = [(i, i + len(g)) for i, g in grams if telling.get(g, 0) >= 0.7 * best]
                stretches[word[min(near)[0] : max(end for _, end in near)]] += 1
    chosen: list[bytes] = []
    for stretch, n in sorted(stretches.items(), key=lambda s: (-s[1], s[0])):
        if n >= least and not any(c in stretch for c in chosen):
            chosen.append(stretch)
    return b"".join(at_every_step(c) for c in reversed(chosen))


@dataclass(frozen=True)
class Model:
    """The dictionaries and the weights of the calibration. ``plain`` and
    ``toxic`` are of equal size, ``telling`` is more than ``ordinary``."""

    ordinary: bytes
    telling: bytes
    plain: bytes
    toxic: bytes
    weights: tuple[float, ...]
    base_rate: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False
    )


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.weights:
            self.ordinary = _compressor(model.ordinary).compress
            self.telling = _compressor(model.telling).compress
            self.plain = _compressor(model.plain).compress
            self.toxic = _compressor(model.toxic).compress

    def features(self, text: str) -> list[float]:
        found = windows(text)
        ordinary, telling, plain, toxic = self.ordinary, self.telling, self.plain, self.toxic
        gains = np.array([len(ordinary(w)) - len(telling(w)) for w in found])
        wording = np.array([len(plain(w)) - len(toxic(w)) for w in found])
        over = [np.log1p(np.count_nonzero(gains >= m)) for m in MARGINS]
        return [1.0, *over, np.log(len(found)), max(0.0, float(gains.max())),
                float(wording.mean()), max(0.0, float(wording.max()))]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.model.weights:
            return np.full(len(texts), self.model.base_rate)
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights), -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a slight ridge, by Newton's method."""
    beta, ridge = np.zeros(x.shape[1]), 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        spread = weight * p * (1 - p)
        hessian = (x * spread[:, None]).T @ x + ridge * np.eye(len(beta))
        beta += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * beta)
    return beta


def dictionary(texts: list[str], most: int) -> bytes:
    """A dictionary of up to so many bytes, trained on the windows of texts."""
    samples = [w for t in texts for w in windows(t)]
    size = min(most, sum(map(len, samples)) // 4)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to find repeats in
        return b"".join(samples)[: max(1, size)]


def train(labelled: list[tuple[int, str, int]], base_rate: float) -> Model:
    """A model of (id, text, label) rows of the sample; two thirds of them, by a
    hash of the id, for the dictionaries and a third for the calibration.

    ``base_rate`` is the share of label 1 among all labelled rows, which the
    sample need not have. Without enough rows of both labels the model scores
    every text by the base rate.
    """
    parts: list[list[tuple[str, int]]] = [[], []]
    for doc_id, text, label in labelled:
        parts[zlib.crc32(f"part {doc_id}".encode()) % 3 == 0].append((text, label))
    toxic = [t for t, y in parts[0] if y]
    ordinary = [t for t, y in parts[0] if not y]
    y = np.array([label for _, label in parts[1]], float)
    if len(toxic) < GRAM_DOCS or len(ordinary) < GRAM_DOCS or not 0 < y.sum() < len(y):
        return Model(b"", b"", b"", b"", (), base_rate)
    content = dictionary(ordinary, ORDINARY_BYTES)
    worded = dictionary(toxic, ORDINARY_BYTES)
    plain = dictionary(ordinary, len(worded))
    size = min(len(plain), len(worded))
    # A dictionary's end is what a match costs least to reach.
    forms = (content, content + telling_content(toxic, ordinary), plain[-size:], worded[-size:])
    draft = Model(*forms, (0.0,), base_rate)
    scorer = Scorer(draft)
    x = np.array([scorer.features(t) for t, _ in parts[1]])
    share = y.mean()
    rate = min(max(base_rate, 0.01), 0.99)
    weight = np.where(y > 0, rate / share, (1 - rate) / (1 - share))
    return Model(*forms, tuple(_regression(x, y, weight)), base_rate)


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Train on labelled rows that are not held out.

    Rows without id, label or text are passed over; of repeated rows any may be
    taken. Only the bounded sample comes to the driver.
    """
    usable = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out("id")
    )
    total, toxic = usable.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    base_rate = (toxic + 1) / (total + 2)
    order = [F.xxhash64("id"), F.col("id")]
    chosen = None
    for label, rows in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        part = usable.filter(F.col("label") == label).orderBy(*order).limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most TOXIC_ROWS + ORDINARY_ROWS ids: small enough to broadcast at any size.
    ids = docs.sparkSession.createDataFrame(
        [tuple(r) for r in chosen.collect()], "id bigint, label int"
    )
    bodies = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).filter(
        F.char_length("body") <= SAMPLE_CHARS
    )
    rows = (
        bodies.join(F.broadcast(ids), "id")
        .orderBy("id", "body")
        .limit(TOXIC_ROWS + ORDINARY_ROWS)
        .collect()
    )
    return train([(r.id, r.body, r.label) for r in rows], base_rate)


@lru_cache(maxsize=2)
def scorer(model: Model) -> Scorer:
    return Scorer(model)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1, from the whole text and nothing else.

    NULL and empty texts are scored as one empty window. Equal texts score
    equally; other columns stay, one named ``out`` is replaced; an empty table
    stays empty.
    """
    prepare_workers(df.sparkSession)

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(scorer(model).scores(texts.to_pylist()), pa.float64())

    return df.withColumn(out, scored(whole_text(text)))


def is_toxic(score_column: str = "score", threshold: float = THRESHOLD) -> Column:
    return F.col(score_column) >= threshold
