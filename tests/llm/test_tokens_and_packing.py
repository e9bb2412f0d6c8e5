import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lexisieve.llm import dropout, packing, simple8b
from lexisieve.llm.encoding import BYTE_BPE, WordEncoder

TEXTS = [
    None, "", " ", "one word", "It's  you'll  'quoted' they've\n\n  x1234  5", "größe ça va — naïve\ttab\r\n", "漢字 🙂 ²³ ½ a b",
    "<|endoftext|> inside", "same same same", "same same same", "ab " * 3000, "_under_score__ ?!... ",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture
def docs(spark):
    rows = [(i * 7 % 12, t, "x", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_give_the_ids_of_the_whole_text(library):
    encoder = WordEncoder(BYTE_BPE)
    for _ in range(2):  # new words, then known ones
        for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
            assert np.frombuffer(ids, "<u2").tolist() == library(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab' \t\n\r1.,_é×\x0b\x1c²", " ", "  ", "\n ", " word", "<|endoftext|>"]), max_size=25).map("".join))
def test_any_text_is_split_alike(text):
    for encoder in _ENCODERS:
        want = encoder.library.encode(text, add_special_tokens=False).ids
        for _ in range(2):  # new chunks, then known ones
            assert np.frombuffer(encoder.encode([text])[0], "<u2").tolist() == want


_ENCODERS = [WordEncoder(BYTE_BPE, literal) for literal in (False, True)]


def test_special_tokens_are_the_librarys_unless_literal():
    text = "hello <|endoftext|> x"
    ids = [np.frombuffer(e.encode([text])[0], "<u2").tolist() for e in _ENCODERS]
    assert ids[0] == [31373, 220, 50256, 2124] and len(ids[1]) == 9


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 5000), st.integers(0, (1 << 32) - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    assert simple8b.unpack(simple8b.pack(np.array(ids, np.uint64))).tolist() == ids


def test_simple8b_blocks_and_escapes():
    ids = np.random.default_rng(0).integers(0, 4000, 40_000)
    ids[::50] = 60_000
    payload = simple8b.pack(ids)
    assert (simple8b.unpack(payload) == ids).all() and len(payload) < 1.8 * len(ids)
    assert (simple8b.unpack_block(payload, 1) == ids[simple8b.BLOCK_IDS:2 * simple8b.BLOCK_IDS]).all()
    with pytest.raises(ValueError):
        simple8b.pack(np.array([1 << 32], np.uint64))
    with pytest.raises(ValueError):
        simple8b.unpack(b"else" + payload[4:])


def test_files_hold_all_documents_in_order(spark, docs, tmp_path, library):
    simple8b.write_ids(docs, str(tmp_path / "ids"))
    rows = {r.doc_id: r for r in simple8b.read_ids(spark.read.parquet(str(tmp_path / "ids"))).collect()}
    start = 0
    for row in docs.orderBy("doc_id").collect():
        ids = [*library(row.text), 2]
        assert (rows[row.doc_id].start, rows[row.doc_id].n_tokens, rows[row.doc_id].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_files_of_an_empty_table(spark, docs, tmp_path):
    simple8b.write_ids(docs.where("false"), str(tmp_path / "none"))
    assert simple8b.read_ids(spark.read.parquet(str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("copies", [1, 40])
def test_packing_places_every_id_once(spark, docs, library, copies):
    many = docs.crossJoin(spark.range(copies).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") * 100 + F.col("k"))
    texts = {r.doc_id: r.text for r in many.collect()}
    rows = packing.pack_documents(many, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for doc_id, parts in pieces.items():
        parts.sort(key=lambda r: r.start)
        ids = [*library(texts[doc_id]), 0]
        assert [i for p in parts for i in p.ids] == ids
        assert all(p.doc_tokens == len(ids) and crc(p.ids) == p.ids_crc32 and p.length == len(p.ids) for p in parts)
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert sum(p.length for p in parts) <= 1024
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_differencing_is_nearly_equal():
    lengths = np.random.default_rng(3).integers(1, 257, 2000)
    window = packing.deal(lengths, 1024)
    sums = np.bincount(window, weights=lengths)
    assert sums.max() <= 1024 and lengths.sum() > 0.98 * 1024 * len(sums) and sums.max() - sums.min() < 60
    assert packing.deal(np.array([1024, 1, 1024]), 1024).tolist().__len__() == 3


def test_dropout_decodes_and_varies(spark, docs):
    encoded = dropout.encode(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    again = {r.doc_id: r.ids for r in dropout.encode(docs.repartition(3)).collect()}
    for r in dropout.decode(encoded).collect():
        assert r.text == texts[r.doc_id] and r.ids == again[r.doc_id]
    model = dropout.MergeDropout(dropout.PIECE_BPE, 1, 0.3)
    word = "an interesting thing " * 10
    assert model.encode(word, 1) != model.encode(word, 2)
    assert len({model.part(" interesting", v) for v in range(dropout.VARIANTS)}) > 1
    marked = "x▁y ▁▁ \n▁"
    assert model.decode(np.frombuffer(model.encode(marked, 0), "<u2")) == marked


def test_no_dropout_is_the_library(spark):
    library = SentencePieceProcessor(model_file=public_tokenizers.path(dropout.PIECE_BPE))
    model = dropout.MergeDropout(dropout.PIECE_BPE, 5, 0.0)
    for text in TEXTS[1:]:
        assert np.frombuffer(model.encode(text, 3), "<u2").tolist() == library.encode(text)


def test_both_agendas_agree():
    model = dropout.MergeDropout(dropout.PIECE_BPE, 3, 0.2)
    for part in [" interesting", "  words", "ééé漢", "\n\n", " ", "a", " aaaaaaaaaaaaaaaaaaaaaaaaa", "    return"]:
        for variant in range(dropout.VARIANTS):
            assert model.part(part, variant) == model.long_part(part, variant)
