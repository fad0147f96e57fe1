"""Unigram encoding against the sentencepiece library, chunked against whole, and reading back."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from squallframe.llm.piece_scan import UnigramModel, cut_chunks, decode_documents, encode_documents, marked_text, max_plus, scan, split_words
from squallframe.llm.piece_scan_query import query

PATH, FOLDER = public_tokenizers.path("piece_bpe_32k.model"), "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return UnigramModel.from_file(PATH)


@pytest.fixture(scope="module")
def library(model):
    """The same pieces and scores in the library's own unigram encoder."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        if piece.piece in model.pieces:
            piece.score = model.pieces[piece.piece][0]
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def ids(model, text):
    return np.frombuffer(model.encode([marked_text(text)])[0], "<u4").tolist()


def test_library_agrees(spark, model, library):
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    lines = [line[:600] for t in texts for line in t.split("\n")] + ["", " ", "a  b   c ", "x" * 40, "héllo wörld", "日本語 🙂 text", "=" * 50, "end  "]
    for line in lines:
        assert ids(model, line) == library.encode(line), line


def test_words_and_chunks_partition_the_text(model):
    for text in ("", "a", " a  b", "a  ", "  "):
        assert "".join(split_words(marked_text(text))) == marked_text(text)
    marked = marked_text("ab cd " * 30 + "x" * 300 + " tail")
    cut = cut_chunks(marked, model, 40)
    assert "".join(c[0] for c in cut) == marked and any(c[3] for c in cut) and [c[3] for c in cut[:-1]] == [c[2] for c in cut[1:]]


def test_scan_is_the_product_from_the_left():
    rng = np.random.default_rng(0)
    parts = [rng.integers(-50, 0, (4, 4)) for _ in range(9)]
    left = [parts[0]]
    for p in parts[1:]:
        left.append(max_plus(left[-1], p))
    assert all((a == b).all() for a, b in zip(scan(parts), left))


@pytest.mark.parametrize("chunk", [20, 37, 100])
def test_chunked_is_whole(spark, model, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choices("thenagio= ", [9, 9, 9, 9, 9, 9, 9, 9, 9, spaces], k=400)) for spaces in (0, 0.3, 3, 30)]
    texts += ["=" * 333, "日本" * 70, "a" * 500, " " * 120, "é" * 20, "", None, "ab cd"]
    df = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)] + [(0, texts[0], b""), (None, texts[1], b"")], "doc_id long, text string, ids binary")
    out = decode_documents(encode_documents(df, PATH, chunk=chunk), PATH).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = texts[1 if r.doc_id is None else r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == np.frombuffer(model.word(marked_text(text)), "<u4").tolist() and r.text == text


def test_query_on_documents(spark, model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = query(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = model.encode([marked_text(texts[r.doc_id])])[0]
        assert (r.n_pieces, r.ids_crc32) == (len(raw) // 4, zlib.crc32(raw))
        assert (r.decoded_chars, r.decoded_sha256) == (len(texts[r.doc_id]), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_read_back_in_the_encoding_stage(spark):
    df = spark.createDataFrame([(1, "ab cd"), (2, None), (None, "x" * 900), (3, "é=" * 600), (3, "é=" * 600)], "doc_id long, text string")
    once, twice = encode_documents(df, PATH, chunk=100, read_back=True), decode_documents(encode_documents(df, PATH, chunk=100), PATH)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    plan = query(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan.split("Union")[0]


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
