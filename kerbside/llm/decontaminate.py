"""Benchmark passages in documents, by SimHash of item-sized windows.

Items are grouped into classes of similar length. A class has a window a little
smaller than its smallest item, and every position of that window in an item is
fingerprinted. Documents are fingerprinted with the same window at strides that
put at least one whole window into any copy of an item. Fingerprints within a
Hamming radius are found without comparing all: of four 16-bit blocks at least
one must lie within a quarter of the radius, so each item fingerprint is filed
under all block values that near, for every block. Exact weighted similarity of
word shingles verifies what is found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kerbside.llm.common import (
    SIMILARITY,
    WORDS_PER_SHINGLE,
    prepare_workers,
    runs,
    shared_folder,
    stored,
    whole_text,
)
from kerbside.llm.shingles import shingles_of
from kerbside.llm.words import words_of_texts

RADIUS = 11
BLOCKS, BLOCK_BITS = 4, 16
WINDOW_SHARE = 0.8  # of the smallest item of a class
CLASS_SPAN = 1.4  # largest to smallest item of a class
ITEMS_PER_BLOCK = 2_000  # items are searched for in blocks of about so many
SEGMENT = 40_000  # shingles fingerprinted at once

# All 16-bit values with so few bits set that a block may differ in.
NEAR = np.array(
    [sum(1 << b for b in bits)
     for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)],
    np.int64,
)


def window_prints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at ``starts``: a bit is set
    where most shingles of the window have it set."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(bits) + 1, 64), np.uint16)  # differences are right though sums wrap
    np.cumsum(bits, axis=0, dtype=np.uint16, out=sums[1:])
    return prints_of(sums, starts, size)


def prints_of(sums: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    most = (sums[starts + size] - sums[starts]) > np.uint16(size // 2)
    return np.packbits(most, axis=1).view(np.uint64).ravel()


class WindowClass:
    """Items of similar length, their window, and the index of its fingerprints."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        least = min(len(s) for _, s in items)
        self.size = max(1, int(WINDOW_SHARE * least))
        self.stride = least - self.size + 1
        prints, owners, offsets = [], [], []
        for number, shingles in items:
            at = np.arange(len(shingles) - self.size + 1)
            prints.append(window_prints(shingles, at, self.size))
            owners.append(np.full(len(at), number))
            offsets.append(at)
        self.prints = np.concatenate(prints)
        self.owners, self.offsets = np.concatenate(owners), np.concatenate(offsets)
        self.tables = [self._file(b) for b in range(BLOCKS)]

    def _file(self, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the entries of each block value start, how many there are, and
        the fingerprints they stand for."""
        values = self.block(self.prints, block)
        near = (values[:, None] ^ NEAR).astype(np.uint16).ravel()
        # Every Python worker holds these tables; a block's entries fit 32 bits.
        numbers = np.repeat(np.arange(len(values), dtype=np.int32), len(NEAR))
        entry = numbers[np.argsort(near, kind="stable")]
        counts = np.bincount(near, minlength=1 << BLOCK_BITS)
        starts = np.cumsum(counts) - counts
        return starts.astype(np.int32), counts.astype(np.int32), entry

    @staticmethod
    def block(prints: np.ndarray, block: int) -> np.ndarray:
        shifted = prints >> np.uint64(block * BLOCK_BITS)
        return (shifted & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def within_radius(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in ``prints``, item fingerprint) within the radius."""
        left, right = [], []
        for block, (starts, counts, entries) in enumerate(self.tables):
            values = self.block(prints, block)
            n = counts[values]
            window = np.repeat(np.arange(len(prints)), n)
            entry = entries[runs(starts[values], n)]
            close = np.bitwise_count(prints[window] ^ self.prints[entry]) <= RADIUS
            left.append(window[close])
            right.append(entry[close])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return pairs[0], pairs[1]


@dataclass(frozen=True)
class Block:
    """Items to search for at once, and what the whole benchmark says of their
    shingles: how many items it has, and the shingles (ascending) that more than
    one of these holds with the number of holders, both packed."""

    items: tuple[tuple[int, str], ...]
    total: int
    common: bytes
    holders: bytes


class ItemIndex:
    """All items of a block: window classes, exact runs for short items, weights."""

    def __init__(self, block: Block):
        items = block.items
        self.ids = [item_id for item_id, _ in items]
        words = words_of_texts([text for _, text in items])
        self.shingles = [shingles_of(w) for w in words]
        holders = zip(
            np.frombuffer(block.common, np.uint64).tolist(),
            np.frombuffer(block.holders, np.int64).tolist(),
        )
        self.weight = {s: np.log1p(block.total / n) for s, n in holders}
        self.rare = float(np.log1p(block.total))
        self.short: dict[int, dict[int, list[int]]] = {}
        sized = []
        for number, w in enumerate(words):
            if 0 < len(w) < WORDS_PER_SHINGLE:
                run = int(self.shingles[number][0])
                self.short.setdefault(len(w), {}).setdefault(run, []).append(number)
            elif len(w):
                sized.append((number, self.shingles[number]))
        sized.sort(key=lambda i: len(i[1]))
        self.classes, group = [], []
        for item in sized:
            if group and len(item[1]) > CLASS_SPAN * len(group[0][1]):
                self.classes.append(WindowClass(group))
                group = []
            group.append(item)
        if group:
            self.classes.append(WindowClass(group))
        self.longest = max((len(s) for s in self.shingles), default=1)

    def similarity(self, shingles: np.ndarray, number: int) -> tuple[float, int, int]:
        """Weighted Jaccard similarity of an item and the part of a window from
        its first to its last shared shingle, and where that part lies."""
        item = self.shingles[number]
        shared = np.flatnonzero(np.isin(shingles, item))
        if not len(shared):
            return 0.0, 0, 0
        first, last = int(shared[0]), int(shared[-1]) + 1
        ours, theirs = Counter(shingles[first:last].tolist()), Counter(item.tolist())
        least = most = 0.0
        for s in ours.keys() | theirs.keys():
            weight = self.weight.get(s, self.rare)
            least += weight * min(ours[s], theirs[s])
            most += weight * max(ours[s], theirs[s])
        return least / most, first, last

    def search(self, texts: list[str]) -> list[dict[int, tuple[float, int, int]]]:
        """Per text: item number -> (similarity, first word, end word)."""
        found: list[dict] = [{} for _ in texts]
        all_words = words_of_texts(texts)
        for size, filed in self.short.items():
            keys = np.array(sorted(filed), np.uint64)
            for k, words in enumerate(all_words):
                if len(words) >= size:
                    grams = shingles_of(words, size)
                    for at in np.flatnonzero(np.isin(grams, keys)).tolist():
                        for number in filed[int(grams[at])]:
                            found[k].setdefault(number, (1.0, at, at + size))
        if not self.classes:
            return found
        documents = [
            shingles_of(w) if len(w) >= WORDS_PER_SHINGLE else w[:0] for w in all_words
        ]
        parts: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for k, shingles in enumerate(documents):
            for at in range(0, max(1, len(shingles)), SEGMENT):
                piece = shingles[at : at + SEGMENT + self.longest]
                parts.append((k, at, piece))
                size += len(piece)
                if size >= SEGMENT:
                    self._search_parts(parts, documents, found)
                    parts, size = [], 0
        if parts:
            self._search_parts(parts, documents, found)
        return found

    def _search_parts(self, parts, documents, found) -> None:
        lengths = np.array([len(p) for _, _, p in parts])
        stream = np.concatenate([p for _, _, p in parts])
        if not len(stream):
            return
        begins = np.cumsum(lengths) - lengths
        bits = np.unpackbits(stream.view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.zeros((len(bits) + 1, 64), np.uint16)
        np.cumsum(bits, axis=0, dtype=np.uint16, out=sums[1:])
        places: set[tuple[int, int, int]] = set()
        for kind in self.classes:
            n = np.maximum(0, (lengths - kind.size) // kind.stride + 1)
            owner = np.repeat(np.arange(len(parts)), n)
            step = runs(np.zeros(len(n), np.int64), n)
            starts = begins[owner] + step * kind.stride
            for at in range(0, len(starts), 50_000):
                some = starts[at : at + 50_000]
                window, entry = kind.within_radius(prints_of(sums, some, kind.size))
                for w, e in zip((window + at).tolist(), entry.tolist()):
                    k, shift, _ = parts[owner[w]]
                    start = int(shift + step[w] * kind.stride - kind.offsets[e])
                    places.add((k, int(kind.owners[e]), start))
        for k, number, start in places:
            first = max(0, start)
            end = start + len(self.shingles[number])
            likeness, a, b = self.similarity(documents[k][first:end], number)
            if likeness >= SIMILARITY:
                row = (likeness, first + a, first + b + WORDS_PER_SHINGLE - 1)
                best = found[k].get(number)
                if best is None or (row[0], -row[1]) > (best[0], -best[1]):
                    found[k][number] = row


@lru_cache(maxsize=4)
def index_of(block: Block) -> ItemIndex:
    return ItemIndex(block)


LEAKS = pa.list_(pa.struct([
    ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int32()),
    ("end_word", pa.int32()),
]))
LEAKS_TYPE = "array<struct<item_id:bigint,similarity:double,first_word:int,end_word:int>>"


def item_shingles(items: DataFrame) -> DataFrame:
    """(block, shingle) of every item, each shingle once an item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [
                np.unique(shingles_of(w)) for w in words_of_texts(batch.column("body").to_pylist())
            ]
            counts = [len(o) for o in own]
            blocks = np.repeat(batch.column("block").to_numpy(), counts)
            flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks), pa.array(flat)], names=["block", "shingle"]
            )

    return items.select("block", "body").mapInArrow(split, "block bigint, shingle bigint")


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> list[Block]:
    """The items in blocks of about ``ITEMS_PER_BLOCK``, whose texts alone are
    sent to tasks at once; weights are those of the whole benchmark. The
    benchmark is the stated query set; NULL and empty items match nothing and
    are left out."""
    usable = benchmark.select(
        F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("body")
    ).filter(F.length("body") > 0).distinct()
    total = usable.count()
    blocks = max(1, -(-total // ITEMS_PER_BLOCK))
    numbered = usable.withColumn("block", F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)))
    parts = item_shingles(numbered)
    common = parts.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    told = stored(
        parts.distinct().join(common, "shingle"), shared_folder(benchmark.sparkSession), "holders"
    )
    out = []
    for b in range(blocks):
        rows = numbered.filter(F.col("block") == b).collect()
        items = sorted(
            ((r.item_id, r.body) for r in rows), key=lambda i: (i[0] is None, i[0] or 0, i[1])
        )
        own = told.filter(F.col("block") == b).select("shingle", "n").toArrow()
        shingles = own.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(shingles)
        counts = own.column("n").to_numpy().astype(np.int64)
        out.append(Block(tuple(items), total, shingles[order].tobytes(), counts[order].tobytes()))
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    leaks: str = "leaks",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Adds ``leaks``: the items that some window of the whole text is similar to
    (0.8 or more), each with its best window as word positions, end exclusive.

    NULL and empty texts have none, nor has any text without items. Items of
    fewer than five words are found where they stand word for word. Case and
    signs at the ends of words are ignored. Of windows equally similar the first
    counts. Rows are independent: repeated rows have equal leaks; other columns
    stay, one named ``leaks`` is replaced.
    """
    prepare_workers(docs.sparkSession)

    def searcher(block: Block):
        held = docs.sparkSession.sparkContext.broadcast(block)

        @arrow_udf(LEAKS_TYPE)
        def search(texts: pa.Array) -> pa.Array:
            index = index_of(held.value)
            rows = [
                [
                    {"item_id": index.ids[n], "similarity": s, "first_word": a, "end_word": b}
                    for n, (s, a, b) in sorted(found.items())
                ]
                for found in index.search(texts.to_pylist())
            ]
            return pa.array(rows, LEAKS)

        return search

    blocks = [b for b in item_blocks(benchmark, item_id, item_text) if b.items]
    columns: list[Column] = [searcher(block)(whole_text(text)) for block in blocks]
    if not columns:
        columns = [F.array().cast(LEAKS_TYPE)]
    return docs.withColumn(leaks, columns[0] if len(columns) == 1 else F.concat(*columns))
