"""Hashes of the words of texts, and how many documents hold each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import prepare_workers, whole_text
from kerbside.llm.hashing import mix, prefix_sums, run_hashes

PIECE = 400_000  # characters hashed at once
POINTS = 0x110000


class Characters:
    """What each code point is: part of a word or not, filled in as met."""

    def __init__(self):
        self.known = np.full(POINTS, 2, np.uint8)
        self.codes = mix(np.arange(1, POINTS + 1, dtype=np.uint64))

    def in_word(self, points: np.ndarray) -> np.ndarray:
        found = self.known[points]
        if (found == 2).any():
            for point in np.unique(points[found == 2]).tolist():
                self.known[point] = chr(point).isalnum() or chr(point) == "_"
            found = self.known[points]
        return found.astype(bool)


CHARACTERS: list[Characters] = []


def _characters() -> Characters:
    if not CHARACTERS:
        CHARACTERS.append(Characters())
    return CHARACTERS[0]


def _pieces(text: str) -> list[str]:
    """A very long text cut where no word is."""
    parts = []
    while len(text) > PIECE:
        at = max(text.rfind(" ", 0, PIECE), text.rfind("\n", 0, PIECE))
        if at <= 0:
            break
        parts.append(text[:at])
        text = text[at:]
    return [*parts, text]


def words_of_texts(texts: list[str]) -> list[np.ndarray]:
    """The 64-bit hashes of every text's words, in order. Words are runs of
    letters, digits and underscores, in lower case."""
    characters = _characters()
    out: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, str]] = []
    size = 0

    def work() -> None:
        line = "\n".join(p for _, p in waiting) + "\n"
        points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        inside = np.zeros(len(points) + 1, np.int8)
        inside[:-1] = characters.in_word(points)
        edges = np.flatnonzero(np.diff(inside, prepend=0))
        starts, stops = edges[::2], edges[1::2]
        sums = prefix_sums(characters.codes[points])
        hashes = mix(run_hashes(sums, starts, stops) ^ (stops - starts).astype(np.uint64))
        ends = np.cumsum([len(p) + 1 for _, p in waiting])
        cuts = np.searchsorted(starts, ends[:-1])
        for (k, _), part in zip(waiting, np.split(hashes, cuts)):
            out[k].append(part)

    for k, text in enumerate(texts):
        for piece in _pieces(text.lower()):
            waiting.append((k, piece))
            size += len(piece)
            if size >= PIECE:
                work()
                waiting.clear()
                size = 0
    if waiting:
        work()
    return [p[0] if len(p) == 1 else np.concatenate(p) for p in out]


def word_hashes(text: str) -> np.ndarray:
    return words_of_texts([text])[0]


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word hash as bigint, df): the documents that hold each word.

    Every task adds up its own documents first, so the shuffle gets a row for
    each distinct word of a task, however common the word is.
    """
    prepare_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for hashes in words_of_texts(batch.column(0).to_pylist()):
                waiting.append(np.unique(hashes))
                size += len(waiting[-1])
            if size > 2_000_000:
                words, counts = merged(words, counts, waiting)
                waiting, size = [], 0
                if len(words) > 2_000_000:
                    yield frequency_batch(words, counts)
                    words, counts = words[:0], counts[:0]
        words, counts = merged(words, counts, waiting)
        yield frequency_batch(words, counts)

    parts = docs.select(whole_text(text).alias("body")).mapInArrow(count, "word bigint, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("df"))


def merged(words, counts, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    # Places of all that is found would take several times its memory.
    new, n = np.unique(np.concatenate([words[:0], *found]), return_counts=True)
    out, place = np.unique(np.concatenate([words, new]), return_inverse=True)
    weights = np.concatenate([counts, n])
    return out, np.bincount(place, weights, minlength=len(out)).astype(np.int64)


def frequency_batch(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"]
    )
