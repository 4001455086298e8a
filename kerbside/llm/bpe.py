"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece's symbols are leaves of a tree whose nodes hold the least (rank, place)
of the pairs below them. The root thus names the leftmost pair of lowest rank;
merging it changes three leaves, each a logarithmic update, until no pair that
can be merged is left. Many pieces are worked on at once: a tree is a row of a
numpy array, and one step takes every unfinished row's root. Where few pieces of
a width come together, long ones above all, each has a tree to itself.

Handles byte-level tokenizers (``ByteLevel`` pre-tokenizer without prefix
space) in the file format of the tokenizers library, and gives its ids.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kerbside.llm.common import PieceMemo, prepare_workers, runs, whole_text

# The pattern by which byte-level BPE cuts text into pieces.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# A space after other white space: there a piece may span words.
WIDE_SPACE = regex.compile(r"\s ")
TREE_CELLS = 500_000
ROWS_AT_ONCE = 32  # fewer pieces are merged one by one
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 for itself, the other bytes from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [names[b] for b in range(256)]


class PairRanks:
    """Hash table from a pair of symbols to its merge's rank, for whole arrays."""

    BITS = 19
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.ranks = np.zeros(1 << self.BITS, np.int64)
        packed = (pairs[:, 0] << 32) | pairs[:, 1]
        slots = self._slots(packed)
        for key, slot, rank in zip(packed.tolist(), slots.tolist(), range(len(pairs))):
            while self.keys[slot] not in (-1, key):
                slot = (slot + 1) & ((1 << self.BITS) - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * self.FACTOR
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or -1 where the pair has no merge."""
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        found = self.keys[slots]
        ranks = np.where(found == keys, self.ranks[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            ranks[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return ranks


class SegmentTreeBpe:
    """Merges of one vocabulary, applied to batches of byte pieces."""

    def __init__(self, vocab: dict[str, int], merges: list):
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[s] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranks = PairRanks(np.array([[vocab[a], vocab[b]] for a, b in pairs], np.int64))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.symbol_of_rank = self.merged.tolist()
        self.rank_of: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            self.rank_of.setdefault(vocab[a] << 32 | vocab[b], rank)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        counts, done = np.zeros(len(pieces), np.int64), []
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            step = max(1, TREE_CELLS // (2 * width))
            for at in range(0, len(members), step):
                some = members[at : at + step]
                if len(some) < ROWS_AT_ONCE:
                    alone = [self._merge_one(pieces[i]) for i in some.tolist()]
                    counts[some] = [len(ids) for ids in alone]
                    done.append((some, np.concatenate(alone)))
                    continue
                ids, alive = self._merge([pieces[i] for i in some.tolist()], width)
                counts[some] = alive.sum(axis=1)
                done.append((some, ids[alive]))
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for some, ids in done:
            out[runs(starts[some], counts[some])] = ids
        return out, counts

    def _merge_one(self, piece: bytes) -> np.ndarray:
        """Ids of one piece. Places need no more than a few bytes each, so that a
        piece of many megabytes can be held."""
        n = len(piece)
        ids = array("i", self.of_byte[np.frombuffer(piece, np.uint8)].tobytes())
        if n < 2:
            return np.asarray(ids, np.int32)
        width = 1 << (n - 1).bit_length()
        first = self.ranks.of(np.asarray(ids)[:-1], np.asarray(ids)[1:])
        grown = np.full(2 * width, NONE)
        grown[width : width + n - 1] = np.where(first >= 0, first * width + np.arange(n - 1), NONE)
        size = width
        while size > 1:
            grown[size // 2 : size] = grown[size : 2 * size].reshape(-1, 2).min(axis=1)
            size //= 2
        tree = array("q", grown.tobytes())
        after = array("i", range(1, n + 1))
        before = array("i", range(-1, n - 1))
        rank_of, merged, none = self.rank_of.get, self.symbol_of_rank, NONE

        def put(node: int, key: int) -> None:
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                if other < key:
                    key = other
                if tree[node] == key:
                    return
                tree[node] = key

        def key_of(left: int, right: int) -> int:
            rank = rank_of(ids[left] << 32 | ids[right])
            return none if rank is None else rank * width + left

        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            then = after[gone]
            ids[at], ids[gone] = merged[rank], -1
            after[at] = then
            put(width + gone, none)
            if then < n:
                before[then] = at
                put(width + at, key_of(at, then))
            else:
                put(width + at, none)
            if before[at] >= 0:
                put(width + before[at], key_of(before[at], at))
        out = np.asarray(ids, np.int32)
        return out[out >= 0]

    def _merge(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(pieces)
        padded = b"".join(p.ljust(width, b"\0") for p in pieces)
        ids = self.of_byte[np.frombuffer(padded, np.uint8)].reshape(rows, width)
        lengths = np.fromiter(map(len, pieces), np.int64, rows)
        place = np.arange(width)
        alive = place < lengths[:, None]
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))

        # Nodes 1 .. 2*width-1, leaves last; the root is node 1.
        tree = np.full((rows, 2 * width), NONE)
        first = self.ranks.of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, -1)
        usable = (first >= 0) & alive[:, 1:]
        leaves = tree[:, width : 2 * width - 1]
        leaves[usable] = (first * width + place[:-1])[usable]
        size = width
        while size > 1:
            half = size // 2
            np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2],
                       out=tree[:, half:size])
            size = half

        active = np.flatnonzero(tree[:, 1] < NONE)
        while len(active):
            rank, at = np.divmod(tree[active, 1], width)
            gone = after[active, at]
            then = after[active, gone]
            ids[active, at] = self.merged[rank]
            alive[active, gone] = False
            after[active, at] = then
            more = then < lengths[active]
            before[active[more], then[more]] = at[more]
            self._put(tree, width, active, gone, np.full(len(active), NONE))
            self._put(tree, width, active, at, self._key(ids, active, at, then, more, width))
            left = before[active, at]
            has = left >= 0
            rows_, left = active[has], left[has]
            key = self._key(ids, rows_, left, at[has], np.ones(len(left), bool), width)
            self._put(tree, width, rows_, left, key)
            active = active[tree[active, 1] < NONE]
        return ids, alive

    def _key(self, ids, rows, left, right, present, width) -> np.ndarray:
        keys = np.full(len(rows), NONE)
        r, a, b = rows[present], left[present], right[present]
        rank = self.ranks.of(ids[r, a], ids[r, b])
        keys[present] = np.where(rank >= 0, rank * width + a, NONE)
        return keys

    @staticmethod
    def _put(tree, width, rows, places, keys) -> None:
        """Set one leaf of each row and the nodes above it."""
        node = places + width
        tree[rows, node] = keys
        node = node >> 1
        while len(node) and node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1


class ByteLevelTokenizer:
    """Texts to ids and back, as the tokenizers library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        vocab = spec["model"]["vocab"]
        self.bpe = SegmentTreeBpe(vocab, spec["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len)[::-1]) + ")"
        ) if self.special else None
        self.memo = PieceMemo(self._encode_pieces)

        bytes_of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        entries = {i: b"".join(bytes_of[c] for c in token) for token, i in vocab.items()}
        entries |= {i: text.encode() for text, i in self.special.items()}
        table = [entries.get(i, b"") for i in range(max(entries) + 1)]
        self.byte_counts = np.fromiter(map(len, table), np.int64, len(table))
        self.byte_starts = np.cumsum(self.byte_counts) - self.byte_counts
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def cut(self, text: str) -> list[str]:
        """Pieces to look up. A plain piece stands for itself after a space, one
        with a leading space for what follows that space."""
        special = self.at_special is not None and self.at_special.search(text)
        if not special and not WIDE_SPACE.search(text):
            first, *rest = text.split(" ")
            return [" " + first, *rest]
        pieces = []
        for part in self.at_special.split(text) if special else [text]:
            found = [part] if part in self.special else PIECES.findall(part)
            pieces.extend(" " + p for p in found)
        return pieces

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces cut once more by the pattern; each distinct part is merged once."""
        codes: dict[str, int] = {}
        parts: list[int] = []
        sizes = np.zeros(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            text = piece[1:] if piece[:1] == " " else " " + piece
            if piece.isalpha() or text in self.special:
                sizes[i] = 1
                parts.append(codes.setdefault(text, len(codes)))
            else:
                found = PIECES.findall(text)
                sizes[i] = len(found)
                parts.extend(codes.setdefault(p, len(codes)) for p in found)
        plain = [p.encode() if p not in self.special else b"" for p in codes]
        ids, counts = self.bpe.encode(plain)
        starts = np.cumsum(counts) - counts
        marks = [s for s in self.special if s in codes]
        for mark in marks:
            starts[codes[mark]], counts[codes[mark]] = len(ids), 1
            ids = np.append(ids, self.special[mark])
        used = np.array(parts, np.int64)
        ends = np.concatenate([[0], np.cumsum(counts[used])])[np.cumsum([0, *sizes])]
        return ids[runs(starts[used], counts[used])], np.diff(ends)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and end."""
        return self.memo.ids([self.cut(t) for t in texts])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of id runs; bytes that are no UTF-8 become U+FFFD."""
        counts = self.byte_counts[ids]
        data = self.bytes[runs(self.byte_starts[ids], counts)].tobytes()
        at = np.concatenate([[0], np.cumsum(counts)])[ends].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteLevelTokenizer:
    """One per Python worker and file; workers serve many tasks."""
    return ByteLevelTokenizer(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of each text as ``ids``, an array of int.

    NULL and empty texts give an empty array. Special strings inside a text
    become their ids, as the library's default has it. Texts of any length are
    encoded whole. Rows are independent: repeated rows give repeated results,
    an empty table an empty one, other columns stay; a column of the name
    ``ids`` is replaced.
    """
    prepare_workers(df.sparkSession)

    @arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        values, ends = tokenizer(path).encode(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    return df.withColumn(ids, encoded(whole_text(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of each id array as ``text``, special tokens included.

    A NULL array counts as empty and gives the empty text. Ids outside the
    vocabulary fail. Other columns stay; one of the name ``text`` is replaced.
    """
    prepare_workers(df.sparkSession)

    @arrow_udf("string")
    def decoded(arrays: pa.Array) -> pa.Array:
        counts = np.asarray(arrays.value_lengths().fill_null(0))
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        values = np.asarray(arrays.flatten()).astype(np.int64)
        return pa.array(tokenizer(path).decode(values, ends), pa.string())

    return df.withColumn(text, decoded(F.coalesce(F.col(ids), F.array().cast("array<int>"))))
