"""BPE, token files, token counts: against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbside.llm import bpe, queries, token_count, token_store
from tests.llm.support import FOLDER, HAS_TABLES, LONG, awkward_rows, docs, texts_by_id

BYTES = Tokenizer.from_file(queries.BYTE_BPE)
WORDS = Tokenizer.from_file(queries.WORD_BPE)
needs_tables = pytest.mark.skipif(not HAS_TABLES, reason="no test tables here")

random.seed(5)
SIGNS = "abtheTH éÉß中文🙂\n\t  ’'s.,12²½_- \x1cćİΣς́ ''ll're"
ODD = [
    "", " ", "  ", "a  b", "a   b", " a", "a ", "a\n b", "\n\n  x", "x" * 300, "a" * 5_000,
    "<|endoftext|>", "x<|endoftext|> y <|endoftext|>z", "<|startoftext|>a<|", "'s's 'south ''s",
    *("".join(random.choice(SIGNS) for _ in range(random.randint(0, 60))) for _ in range(400)),
    *("".join(random.choice("aehtrnois") for _ in range(40)) for _ in range(200)),
]


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_segment_tree_gives_the_library_s_ids():
    tool = bpe.ByteLevelTokenizer(queries.BYTE_BPE)
    values, ends = tool.encode(ODD)
    for k, text in enumerate(ODD):
        assert values[ends[k] : ends[k + 1]].tolist() == ids_of(BYTES, text), text
    assert tool.decode(values, ends) == ODD


def test_long_pieces_have_trees_to_themselves(monkeypatch):
    texts = ["".join(random.choice(signs) for _ in range(n))
             for n in (1, 2, 3, 1_000, 1_025, 150_000) for signs in ("etaoinshr", "中文字é", "a")]
    tool = bpe.ByteLevelTokenizer(queries.BYTE_BPE)
    for rows in (0, 1_000):  # all in arrays, for the shorter; all one by one
        monkeypatch.setattr(bpe, "ROWS_AT_ONCE", rows)
        some = texts if rows else texts[:12]
        tool.memo.clear()
        values, ends = tool.encode(some)
        for k, text in enumerate(some):
            assert values[ends[k] : ends[k + 1]].tolist() == ids_of(BYTES, text)


def test_decoding_bytes_that_are_no_text():
    tool = bpe.ByteLevelTokenizer(queries.BYTE_BPE)
    ids = ids_of(BYTES, "é")[:1] if len(ids_of(BYTES, "é")) > 1 else [BYTES.token_to_id("Ã")]
    found = tool.decode(np.array(ids), np.array([0, len(ids)]))
    assert found == [BYTES.decode(ids, skip_special_tokens=False)]


def test_bpe_keeps_rows_and_columns(spark):
    rows = awkward_rows()
    encoded = bpe.encode(docs(spark, rows), queries.BYTE_BPE, ids="tokens")
    found = bpe.decode(encoded, queries.BYTE_BPE, "tokens", "back").collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.tokens == ids_of(BYTES, row.text or "")
        assert row.back == (row.text or "")
    assert encoded.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    empty = bpe.encode(docs(spark, []), queries.BYTE_BPE)
    assert empty.count() == 0 and empty.columns.count("ids") == 1
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert bpe.decode(nothing, queries.BYTE_BPE).first().text == ""


def test_transducer_counts_as_the_library_does():
    tool = token_count.TokenCounter(queries.WORD_BPE)
    assert tool.count(ODD).tolist() == [len(ids_of(WORDS, t)) for t in ODD]
    assert tool.count([]).tolist() == []


def test_chunks_entered_in_another_state_are_mapped_again():
    tool = token_count.TokenCounter(queries.WORD_BPE)
    text = "".join(random.choice("etaoinshr") for _ in range(20_000))
    assert tool.count([text, text]).tolist() == [len(ids_of(WORDS, text))] * 2
    tool.machine.reset()
    assert tool.count([text]).tolist() == [len(ids_of(WORDS, text))]


def test_counts_keep_rows_and_columns(spark):
    found = token_count.count_tokens(docs(spark, awkward_rows()), queries.WORD_BPE, count="ids")
    for row in found.collect():
        assert row.ids == len(ids_of(WORDS, row.text or ""))
    assert token_count.count_tokens(docs(spark, []), queries.WORD_BPE).count() == 0


def test_word_memo_gives_the_library_s_ids():
    tool = token_store.WordTokenizer(queries.WORD_BPE)
    values, ends = tool.encode(ODD)
    for k, text in enumerate(ODD):
        assert values[ends[k] : ends[k + 1]].tolist() == ids_of(WORDS, text), text


def test_memo_starts_afresh_when_full():
    tool = token_store.WordTokenizer(queries.WORD_BPE)
    tool.memo.limit = 3
    for _ in range(3):
        values, ends = tool.encode(["one two three", "four five six two"])
        assert values[: ends[1]].tolist() == ids_of(WORDS, "one two three")


def test_memo_holds_no_more_than_its_size():
    tool = bpe.ByteLevelTokenizer(queries.BYTE_BPE)
    tool.memo.size_limit = 5_000
    for k in range(20):
        tool.encode([f"{k}" + "x" * 1_000])
        assert tool.memo.chars + tool.memo.filled < 5_000 + 2_100


def test_words_with_signs_after_them_give_the_library_s_ids():
    tool = token_store.WordTokenizer(queries.WORD_BPE)
    letters = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha()]
    words = ["".join(random.choices(letters, k=random.randint(1, 8)))
             + "".join(random.choices("'.,!#$%&-=<|>\"", k=random.randint(0, 4)))
             for _ in range(3_000)] + ["we'", "x's", "don't'", "a<|", "É!", "İ.", "Σς,"]
    values, ends = tool.encode(words)
    for k, word in enumerate(words):
        assert values[ends[k] : ends[k + 1]].tolist() == ids_of(WORDS, word), word


def test_store_reads_back_what_it_wrote(spark, tmp_path):
    rows = awkward_rows()
    folder = str(tmp_path / "store")
    manifest = token_store.write(docs(spark, rows), folder, queries.WORD_BPE, 2)
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    found = token_store.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == [0, 1, 2, 3, 4, 7, 7, None, None]
    start = 0
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    for row in found:
        ids = np.frombuffer(row.tokens, "<u4").tolist()
        if row.doc_id is not None:
            assert ids == [*ids_of(WORDS, by_id[row.doc_id] or ""), 2]
        assert row.start == start and row.n_tokens == len(ids)
        start += len(ids)
    some = token_store.read(spark, folder, [3, 7, 99]).collect()
    assert sorted(r.doc_id for r in some) == [3, 7, 7]
    assert {r.start for r in some} <= {r.start for r in found}


def test_store_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path / "none")
    assert token_store.write(docs(spark, []), folder, queries.WORD_BPE, 2).count() == 0
    assert token_store.read(spark, folder).count() == 0


def test_only_wanted_frames_are_read_and_checked(tmp_path):
    path = tmp_path / "one.zst"
    writer = token_store.StoreWriter(open(path, "wb"), wide=True)
    for k in range(5):
        writer.add(k, np.arange(k * 70_000, k * 70_000 + 10))
    writer.close()
    data = bytearray(path.read_bytes())
    with open(path, "rb") as file:
        store = token_store.StoreReader(file, len(data))
        assert store.document(3).tolist() == list(range(210_000, 210_010))
        spoiled = int(store.offsets[1]) + 12
    data[spoiled] ^= 0xFF
    path.write_bytes(data)
    with open(path, "rb") as file:
        store = token_store.StoreReader(file, len(data))
        assert store.document(3).tolist() == list(range(210_000, 210_010))
        with pytest.raises(Exception):  # noqa: B017  the frame or its checksum
            store.document(1)


def test_a_long_document_takes_several_frames(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_TOKENS", 100)
    path = tmp_path / "long.zst"
    writer = token_store.StoreWriter(open(path, "wb"), wide=False)
    writer.add(1, np.arange(250))
    writer.add(None, np.zeros(0, np.int64))
    writer.close()
    with open(path, "rb") as file:
        store = token_store.StoreReader(file, path.stat().st_size)
        assert store.document(0).tolist() == list(range(250))
        assert store.document(1).tolist() == [] and store.null.tolist() == [False, True]
        assert store.places([1]).tolist() == [0]


@needs_tables
def test_queries_on_the_given_documents(spark):
    given = texts_by_id(spark)
    coded = {r.doc_id: r for r in queries.op3_bpe(spark, FOLDER).collect()}
    stored = {r.doc_id: r for r in queries.op4_token_store(spark, FOLDER).collect()}
    counted = {r.doc_id: r for r in queries.op5_token_count(spark, FOLDER).collect()}
    assert set(coded) == set(stored) == set(counted) == set(given)
    start = 0
    for doc_id in sorted(given):
        text = given[doc_id]
        ids = ids_of(BYTES, text)
        assert coded[doc_id].n_tokens == len(ids)
        joined = ",".join(map(str, ids))
        assert coded[doc_id].ids_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert coded[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        ids = ids_of(WORDS, text)
        data = np.array([*ids, 2], "<u4").tobytes()
        row = stored[doc_id]
        assert (row.start, row.n_tokens) == (start, len(ids) + 1)
        assert row.ids_crc32 == zlib.crc32(data)
        start += len(ids) + 1
        row = counted[doc_id]
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), len(ids))
        assert row.over_limit == (len(ids) > 2048)


def test_long_text_is_whole():
    assert len(LONG) > 100_000
    assert public_tokenizers.path("word_bpe_49k.json") == queries.WORD_BPE
