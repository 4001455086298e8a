"""Whitening, packing and ranked search, each against a plain version."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbside.llm import packing, queries, term_search, whitening
from tests.llm.support import FOLDER, HAS_TABLES, awkward_rows, docs, given, texts_by_id
from tests.llm.test_tokens import ODD

needs_tables = pytest.mark.skipif(not HAS_TABLES, reason="no test tables here")
BYTES = Tokenizer.from_file(queries.BYTE_BPE)

# --- whitening -------------------------------------------------------------------


def vectors(spark, rows, more="label string, component int, n string"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<float>, {more}")


def by_hand(kept):
    """x, components, eigenvalues and share of all variance, by numpy."""
    x = np.floor(64 * kept.astype(float)).astype(np.int64) + 1_000_000
    centred = (x * len(x) - x.sum(axis=0)) / len(x)
    values, columns = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1], columns[:, ::-1]


def check_whitened(found, kept, components=32):
    x, centred, values, columns = by_hand(kept)
    m = min(components, len(values))
    assert len(found) == len(kept) * m
    at = {(r.vec_id, r.component): r for r in found}
    got = np.array([[at[k, c + 1].whitened for c in range(m)] for k in range(len(kept))])
    want = centred @ columns[:, :m] / np.sqrt(values[:m])
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got, want * signs, rtol=1e-7, atol=1e-9)
    n, sums = len(x), x.sum(axis=0)
    for k in range(len(kept)):
        assert at[k, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums))
        assert at[k, 1].n == n
    share = values[:m] / values.sum()
    assert np.allclose([at[0, c + 1].explained for c in range(m)], share, rtol=1e-9)
    assert {r.identity_error for r in found} == {found[0].identity_error}
    assert found[0].identity_error < 1e-9


def test_whitening_equals_eigenvectors(spark):
    random = np.random.default_rng(3)
    kept = (random.standard_normal((300, 12)) @ random.standard_normal((12, 12))).astype("f4")
    rows = [(k, v.tolist(), "x", 1, "clash") for k, v in enumerate(kept)]
    bad = [None, [1.0] * 11 + [None], [float("nan")] * 12, [float("inf")] + [0.0] * 11, []]
    rows += [(1000 + k, v, None, None, None) for k, v in enumerate(bad)]
    check_whitened(whitening.whiten(vectors(spark, rows)).collect(), kept)


def test_equal_deviations_and_dimensions_without_spread(spark):
    corners = np.array([[a, b, c, 7] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)], "f4")
    found = whitening.whiten(
        vectors(spark, [(k, v.tolist(), "", 0, "") for k, v in enumerate(corners)])
    ).collect()
    assert {r.component for r in found} == {1, 2, 3}
    assert all(abs(r.explained - 1 / 3) < 1e-12 and r.identity_error < 1e-12 for r in found)


def test_whitening_of_repeats_null_ids_and_few_rows(spark):
    same = [(1, [1.0, 2.0], "", 0, "")] * 3 + [(None, [2.0, 4.5], "", 0, "")]
    found = whitening.whiten(vectors(spark, same)).collect()
    assert Counter(r.vec_id for r in found) == {1: 3, None: 1}
    assert {r.component for r in found} == {1}
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None, "", 0, "")])).collect() == []
    alike = [(k, [1.0, 2.0], "", 0, "") for k in range(5)]
    assert whitening.whiten(vectors(spark, alike)).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        mixed = [(1, [1.0], "", 0, ""), (2, [1.0, 2.0], "", 0, "")]
        whitening.whiten(vectors(spark, mixed)).collect()


@needs_tables
def test_whitening_query(spark):
    rows = sorted(
        (r.vec_id, r.embedding)
        for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    )
    assert [k for k, _ in rows] == list(range(len(rows)))
    found = queries.op11_whitening(spark, FOLDER).collect()
    check_whitened(found, np.array([v for _, v in rows], "f4"))


# --- packing ---------------------------------------------------------------------


def check_packed(rows, texts, capacity=2048, end=1):
    """Every id once and in place, sequences gapless; returns the padding."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, parts in pieces.items():
        ids = BYTES.encode(texts[doc_id] or "", add_special_tokens=False).ids + [end]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(part) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    padding = 0
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / (padding + sum(n for spans in places.values() for _, n in spans))


def test_library_ids_by_either_way(tmp_path):
    plain = packing.LibraryTokens(queries.BYTE_BPE)
    other = packing.LibraryTokens(queries.WORD_BPE)
    assert plain.merges is not None and other.merges is None
    words = Tokenizer.from_file(queries.WORD_BPE)
    texts = [*ODD, "z" * 50_000, " " * 20_000, "中" * 9_000, "a<|endoftext|> b"]
    for tool, library in ((plain, BYTES), (other, words)):
        for text, ids in zip(texts, tool.encode(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [64, 2047, 2048])
def test_cuts_waste_little(capacity):
    for n in [*range(1, 5000), 1_000_003]:
        lengths = packing.cut_lengths(n, capacity)
        assert sum(lengths) == n and min(lengths) > 0 and max(lengths) <= capacity
        assert len(lengths) <= n // capacity + 8
        for rest in lengths:
            share = capacity // (capacity // rest)
            assert rest <= 2 * packing.LEAST_PIECE or (share - rest) * packing.GAP <= share


def test_packing_of_awkward_rows(spark):
    rows = [r for r in awkward_rows() if r[0] is not None and r[0] != 7]
    packed = packing.pack(docs(spark, rows).coalesce(1), queries.BYTE_BPE, 1)
    found = packed.withColumn("ids_crc32", F.crc32("tokens")).collect()
    assert check_packed(found, {r[0]: r[1] for r in rows}) == 0
    every = packing.pack(docs(spark, awkward_rows()), queries.BYTE_BPE, 1)
    starts = Counter(r.doc_id for r in every.collect() if r.start == 0)
    assert starts == Counter(r[0] for r in awkward_rows())
    assert packing.pack(docs(spark, []), queries.BYTE_BPE, 1).collect() == []
    joined = packing.sequences(packed, pad_id=0).collect()
    assert all(len(r.ids) & (len(r.ids) - 1) == 0 for r in joined)
    assert sum(len(r.ids) - r.n_pad for r in joined) == sum(r.length for r in found)


@needs_tables
def test_packing_query(spark):
    rows = queries.op12_packing(spark, FOLDER).collect()
    assert check_packed(rows, texts_by_id(spark)) < 0.02


# --- search ----------------------------------------------------------------------


def plain_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in lower).split(" ")


def plain_search(documents, items, top=20):
    found = [(k, Counter(filter(None, plain_terms(t)))) for k, t in documents]
    found = [(k, c, sum(c.values())) for k, c in found if c]
    total, df = sum(n for *_, n in found), Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(filter(None, plain_terms(text))), []
        for doc_id, c, n in found:
            m = 75 + 25 * n * len(found) // total
            score = sum(
                q * int(1000 * np.log((2 * len(found) + 2) / (2 * df[t] + 1)))
                * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, q in asked.items() if c[t]
            )
            if score:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:top]):
            out.append((item, rank + 1, doc_id, -score))
    return Counter(out)


def test_search_of_awkward_rows(spark):
    rows = [*awkward_rows(), (9, "ÀB àb x1_Y2 x1 the THE the x", "", "", 1, "")]
    rows += [(100 + k, "alpha beta " + "gamma " * (k % 3), "", "", 1, "") for k in range(60)]
    asked = [(1, "alpha BETA gamma beta", "kept"), (2, "àb x1 y2 the nowhere", ""), (3, None, ""),
             (4, "", ""), (None, "lorem ipsum", ""), (5, "...", "")]
    items = spark.createDataFrame([*asked, asked[0]], "item_id bigint, text string, score string")
    want = plain_search([r[:2] for r in rows], [a[:2] for a in asked])
    for owners in (1, 3, 7):
        found = term_search.search(docs(spark, rows), items, owners=owners)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, found.collect())) == want
    empty = docs(spark, [])
    assert term_search.search(empty, items).collect() == []
    assert term_search.search(docs(spark, rows), items.limit(0)).collect() == []


@needs_tables
def test_search_in_small_shards_and_bundles(spark, monkeypatch):
    monkeypatch.setattr(term_search, "SHARD_BITS", 4)
    monkeypatch.setattr(term_search, "BUNDLE_ITEMS", 7)
    found = term_search.search(
        spark.read.parquet(f"{FOLDER}/documents.parquet"),
        spark.read.parquet(f"{FOLDER}/benchmark.parquet"),
        top=5,
    )
    items = [(r[0], r[1]) for r in given(spark, "benchmark")]
    texts = sorted(texts_by_id(spark).items())
    assert Counter(map(tuple, found.collect())) == plain_search(texts, items, 5)


@needs_tables
def test_search_query(spark):
    items = [(r[0], r[1]) for r in given(spark, "benchmark")]
    found = Counter(map(tuple, queries.op13_term_search(spark, FOLDER).collect()))
    assert found == plain_search(sorted(texts_by_id(spark).items()), items)
