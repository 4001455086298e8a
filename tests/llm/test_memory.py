"""What the operators keep in Python workers."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from kerbside.llm import decontaminate
from kerbside.llm.shingles import shingles_of
from kerbside.llm.words import merged, word_hashes
from tests.llm.support import LONG, awkward_rows, docs


def test_ids_are_decoded_in_a_stage_of_their_own(spark):
    """A task that encodes and decodes holds two Python workers at a time."""
    rows = awkward_rows()
    tokens = corpus_pipeline.encode_tokens(spark, docs(spark, rows), "")
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    found = tokens.collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


def test_ids_are_stored_in_small_row_groups(spark, tmp_path, monkeypatch):
    """Tasks read whole texts with all their ids a few at a time."""
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    draw = random.Random(4)
    rows = [(k, "".join(draw.choices("abcdefgh ", k=9_000)), "en", "s", 1, "") for k in range(900)]
    tokens = corpus_pipeline.encode_tokens(spark, docs(spark, rows).coalesce(1), "")
    (file,) = (tmp_path / "encoded").glob("*.parquet")
    meta = pq.read_metadata(file)
    assert meta.num_rows == 900 and meta.num_row_groups > 3
    assert tokens.filter("round_trip").count() == 900


def test_counting_words_takes_no_multiple_of_their_memory():
    draw = np.random.default_rng(8)
    found = [draw.integers(0, 5_000, 1_000).astype(np.uint64) for _ in range(500)]
    held, counts = np.array([3, 9_000], np.uint64), np.array([7, 2], np.int64)
    expected = Counter(np.concatenate(found).tolist()) + Counter({3: 7, 9_000: 2})
    tracemalloc.start()
    words, n = merged(held, counts, found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(words.tolist(), n.tolist())) == dict(expected)
    assert words.tolist() == sorted(expected)
    assert peak < 4 * 8 * 500_000
    assert [len(a) for a in merged(held[:0], counts[:0], [])] == [0, 0]


def test_benchmark_index_takes_32_bits_a_number():
    items = [(k, shingles_of(word_hashes(f"{LONG[:400]} {k} end"))) for k in range(20)]
    index = decontaminate.WindowClass(items)
    for starts, counts, entries in index.tables:
        assert {a.dtype for a in (starts, counts, entries)} == {np.dtype(np.int32)}
        assert starts[-1] + counts[-1] == len(entries)
    at, entry = index.within_radius(index.prints)
    apart = np.bitwise_count(index.prints[:, None] ^ index.prints)
    left, right = np.nonzero(apart <= decontaminate.RADIUS)
    assert set(zip(at.tolist(), entry.tolist())) == set(zip(left.tolist(), right.tolist()))
