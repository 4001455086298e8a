"""Token counts by a finite-state transducer compiled from a tokenizer.

A BPE encoding is the one sequence of tokens whose neighbours are compatible
(merging their joined text gives just these two). So what a prefix of a word
can still lead to is known from a few hypotheses: for each place that a token
may yet begin at, how far into the vocabulary's trie its beginning leads, the
token before it, and how many tokens precede it. A set of hypotheses is a state
of a deterministic transducer; each transition is annotated with the change of
the token count. States are compiled when first reached, so that only the part
of the automaton that the corpus needs is built.

Texts become streams of word bytes, the last byte of a piece marked, and the
streams are cut into chunks of equal size. All chunks run at once: each is
mapped from the entry state that the symbols before it suggest to its exit state
and count. The scan then composes neighbours: a chunk whose entry is not its
predecessor's exit is mapped again from there, until all agree. Prefix sums of
the chunk counts give the counts of texts.

Handles lower-casing word BPE with an end-of-word suffix, whose pieces are
letters, single digits, other signs, and the usual contractions.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kerbside.llm.bpe import byte_symbols
from kerbside.llm.common import prepare_workers, whole_text

END = 256  # added to the last byte of a piece
SYMBOLS = 512
CHUNK = 256
WARM_UP = 32
MAX_STATES = 200_000
SLICE_BYTES = 8_000_000

# The tokenizer's pattern and normalizers, as the file states them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

SPACE, LETTER, NUMBER, SIGN, INSIDE = 0, 1, 2, 3, 4


class Transducer:
    """Deterministic automaton over marked bytes; state 0 begins a piece."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        spelled: dict[int, tuple[int, ...]] = {}
        for token, i in vocab.items():
            ends = token.endswith(suffix)
            letters = token.removesuffix(suffix) if ends else token
            if letters and all(c in byte_of for c in letters):
                codes = [byte_of[c] for c in letters]
                spelled[i] = (*codes[:-1], codes[-1] + END * ends)
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merge_rank.setdefault((a, b), rank)
            self.rank.setdefault(whole, rank)
            self.parts.setdefault(whole, (a, b))
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.branches = [False]
        for i, symbols in spelled.items():
            node = 0
            for symbol in symbols:
                at = node * SYMBOLS + symbol
                self.branches[node] = True
                if at not in self.child:
                    self.child[at] = len(self.token)
                    self.token.append(-1)
                    self.branches.append(False)
                node = self.child[at]
            if len(symbols) == 1 or i in self.parts:
                self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first."""
        start = ((0, -1, 0),)
        self.states = [start]
        self.number = {start: 0}
        # Symbols get a column when first met.
        self.column = np.full(SYMBOLS, -1, np.int64)
        self.columns = 0
        self.table = np.full((1024, 64), -1, np.int32)
        self.emits = np.zeros((1024, 64), np.int8)

    def _grow(self, rows: int, columns: int) -> None:
        """More room for states or symbols, in small steps: the tables are large."""
        room = ((0, rows), (0, columns))
        self.table = np.pad(self.table, room, constant_values=-1)
        self.emits = np.pad(self.emits, room)

    def compatible(self, left: int, right: int) -> bool:
        """Do the two tokens stay as they are when their texts are joined?

        Looks back over the merges that made them, latest first. As long as two
        parts stood side by side, no merge of theirs may have been due.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        due = self.merge_rank.get(key)
        fits = due is None
        while fits:
            made_left, made_right = self.rank.get(left, -1), self.rank.get(right, -1)
            if made_left < 0 and made_right < 0:
                break
            # Of two equal tokens the right one is the later, merges run leftmost first.
            if made_right >= made_left:
                right, limit, first = self.parts[right][0], made_right, True
            else:
                left, limit, first = self.parts[left][1], made_left, False
            due = self.merge_rank.get((left, right))
            if due is not None and (due <= limit if first else due < limit):
                fits = False
        self.pairs[key] = fits
        return fits

    def _compile(self, state: int, symbol: int) -> None:
        """The transition of one state and symbol, with its emitted count."""
        alive, found, emitted = [], -1, 0
        for node, last, before in self.states[state]:
            node = self.child.get(node * SYMBOLS + symbol, -1)
            if node < 0:
                continue
            token = self.token[node]
            if found < 0 and token >= 0 and (last < 0 or self.compatible(last, token)):
                found, emitted = token, before + 1
            if self.branches[node]:
                alive.append((node, last, before))
        if found < 0:
            raise ValueError("the vocabulary has no token for some byte")
        if symbol >= END:
            target = 0
        else:
            hypotheses = (
                *((node, last, before - emitted) for node, last, before in alive),
                (0, found, 0),
            )
            target = self.number.setdefault(hypotheses, len(self.states))
            if target == len(self.states):
                self.states.append(hypotheses)
                if target == len(self.table):
                    self._grow(len(self.table) // 4, 0)
        column = self.column[symbol]
        self.table[state, column], self.emits[state, column] = target, emitted

    def columns_of(self, stream: np.ndarray) -> np.ndarray:
        for symbol in np.flatnonzero(np.bincount(stream, minlength=SYMBOLS)).tolist():
            if self.column[symbol] < 0:
                self.column[symbol] = self.columns
                self.columns += 1
                if self.columns > self.table.shape[1]:
                    self._grow(0, 16)
        self.symbol_of = np.zeros(self.columns, np.int64)
        known = np.flatnonzero(self.column >= 0)
        self.symbol_of[self.column[known]] = known
        return self.column[stream]

    def step(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        targets = self.table[states, columns]
        new = np.flatnonzero(targets < 0)
        if len(new):
            width = self.columns
            for key in np.unique(states[new].astype(np.int64) * width + columns[new]).tolist():
                state, column = divmod(key, width)
                self._compile(state, int(self.symbol_of[column]))
            targets[new] = self.table[states[new], columns[new]]
        return targets, self.emits[states, columns]

    def run(self, columns, starts, ends, states) -> tuple[np.ndarray, np.ndarray]:
        """Chunk maps: exit state and emitted count of each chunk."""
        states, counts = states.copy(), np.zeros(len(starts), np.int64)
        longest = int((ends - starts).max(initial=0))
        for k in range(longest):
            going = np.flatnonzero(starts + k < ends) if k >= (ends - starts).min() else slice(None)
            states[going], emitted = self.step(states[going], columns[starts[going] + k])
            counts[going] += emitted
        return states, counts

    def count_at(self, stream: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Tokens of the stream before each place; places begin pieces."""
        if len(self.states) > MAX_STATES:
            self.reset()
        columns = self.columns_of(stream)
        # Chunks are dealt evenly and end anywhere; all run side by side.
        cuts = np.unique(np.concatenate([np.arange(0, len(stream) + 1, CHUNK), places]))
        starts, ends = cuts[:-1], cuts[1:]
        if not len(starts):
            return np.zeros(len(places), np.int64)
        fresh = np.zeros(len(starts), bool)
        fresh[0] = True
        fresh[1:] = stream[starts[1:] - 1] >= END
        warm = np.where(fresh, starts, np.maximum(starts - WARM_UP, 0))
        entries, _ = self.run(columns, warm, starts, np.zeros(len(starts), np.int64))
        entries[fresh] = 0
        exits, counts = self.run(columns, starts, ends, entries)
        while True:
            wrong = np.flatnonzero(entries[1:] != exits[:-1]) + 1
            if not len(wrong):
                break
            entries[wrong] = exits[wrong - 1]
            exits[wrong], counts[wrong] = self.run(
                columns, starts[wrong], ends[wrong], entries[wrong]
            )
        before = np.concatenate([[0], np.cumsum(counts)])
        return before[np.searchsorted(cuts, places)]


class CharClasses:
    """Class of each code point, filled in as code points are met."""

    def __init__(self):
        self.known = np.full(0x110000, 255, np.uint8)
        self.tests = [(LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")),
                      (SPACE, regex.compile(r"\p{White_Space}"))]

    def of(self, points: np.ndarray) -> np.ndarray:
        classes = self.known[points]
        for point in np.unique(points[classes == 255]).tolist():
            char = chr(point)
            self.known[point] = next((c for c, t in self.tests if t.match(char)), SIGN)
        return self.known[points]


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if kinds != NORMALIZERS or split != PATTERN or not model["end_of_word_suffix"]:
            raise ValueError(f"not a lower-casing word BPE: {path}")
        self.machine = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = regex.compile(
            "|".join(regex.escape(t["content"]) for t in spec["added_tokens"])
        )
        self.classes = CharClasses()

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # each letter for itself

    def stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Marked bytes of all pieces, and where each text begins in them."""
        data = "\n".join(texts) + "\n"
        raw = np.frombuffer(data.encode(), np.uint8)
        lengths = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        classes = self._byte_classes(raw, data)
        before = np.empty_like(classes)
        before[0], before[1:] = SPACE, classes[:-1]
        # A byte inside a character goes with its first byte.
        inside = classes == INSIDE
        if inside.any():
            lead = np.maximum.accumulate(np.where(inside, 0, np.arange(len(classes))))
            before[1:] = classes[lead[:-1]]
            whole = classes[lead]
        else:
            whole = classes
        first = (~inside) & (whole != SPACE) & ((whole != before) | (whole == NUMBER))
        self._cut_contractions(raw, whole, before, first)
        used = whole != SPACE
        last = np.zeros(len(raw), bool)
        last[:-1] = first[1:] | (whole[1:] == SPACE)
        symbols = raw.astype(np.int64) + END * (last & used)
        kept = np.concatenate([[0], np.cumsum(used)])
        return symbols[used], kept[begins]

    def _byte_classes(self, raw: np.ndarray, data: str) -> np.ndarray:
        points = np.frombuffer(data.encode("utf-32-le"), np.uint32)
        of_char = self.classes.of(points)
        if len(points) == len(raw):
            return of_char
        classes = np.full(len(raw), INSIDE, np.uint8)
        classes[(raw & 0xC0) != 0x80] = of_char
        return classes

    @staticmethod
    def _cut_contractions(raw, whole, before, first) -> None:
        marks = np.flatnonzero((raw == ord("'")) & (before != SIGN))
        # A contraction may end where the next begins, which changes nothing here:
        # an apostrophe after a letter starts a piece in any case.
        for mark in marks.tolist():
            tail = raw[mark : mark + 3].tobytes().decode("latin-1")
            found = next((c for c in CONTRACTIONS if tail.startswith(c)), None)
            if found:
                end = mark + len(found)
                first[mark + 1] = False
                if whole[end] == LETTER:
                    first[end] = True

    def count(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        ready = []
        for i, text in enumerate(texts):
            if "<|" in text:
                text, extra[i] = self.special.subn("\n", text)
            ready.append(self.normal(text))
        out, at = [], 0
        while at < len(ready):
            stop, size = at, 0
            while stop < len(ready) and (stop == at or size + len(ready[stop]) < SLICE_BYTES):
                size += len(ready[stop])
                stop += 1
            stream, places = self.stream(ready[at:stop])
            out.append(np.diff(self.machine.count_at(stream, places)))
            at = stop
        return np.concatenate([*out, np.zeros(0, np.int64)]) + extra


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text as ``count``.

    NULL and empty texts have 0. Special strings inside a text count as one
    token each, as the library's default has it. Repeated rows count alike, an
    empty table stays empty, other columns stay, one named ``count`` is replaced.
    """
    prepare_workers(df.sparkSession)

    @arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).count(texts.to_pylist()), pa.int64())

    return df.withColumn(count, counted(whole_text(text)))
