"""Token counts against the library on whole texts."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from squallframe.llm import token_counts as module
from squallframe.llm.token_counts import Counter, cuts_are_safe, pieces, token_counts
from squallframe.llm.token_counts_query import query

PATH, FOLDER = public_tokenizers.path("byte_bpe_50k.json"), "/root/testdata/sf0.001"
PARTS = ["a", "Bc", "don't", "'s", "'S5", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "\x1c", "\x00", "é", "日本", "🙂", "12", "x7y", "...", "--",
         "<|endoftext|>", "<|endof", "text|>", "$", "́", "'ll", "9z", "Ａ１"]


def plain(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_pieces_never_change_the_tokens(seed):
    rng, tokenizer = random.Random(seed), Tokenizer.from_file(PATH)
    for _ in range(40):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60)))
        cut = list(pieces(text, rng.randint(1, 9)))
        assert "".join(cut) == text
        whole = tokenizer.encode(text, add_special_tokens=False).ids
        assert [i for p in cut for i in tokenizer.encode(p, add_special_tokens=False).ids] == whole, (text, cut)


def test_only_known_tokenizers_are_cut():
    settings = json.loads(Tokenizer.from_file(PATH).to_str())
    assert cuts_are_safe(settings)
    assert not cuts_are_safe({**settings, "normalizer": {"type": "NFC"}})
    assert not cuts_are_safe({**settings, "pre_tokenizer": {"type": "Whitespace"}})
    assert not cuts_are_safe({**settings, "added_tokens": [{**settings["added_tokens"][0], "content": "two words"}]})
    assert not cuts_are_safe(json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str()))


def test_batches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(module, "BATCH_BYTES", 1000)
    counter, seen = Counter(PATH), []
    counter.size = 100
    encode = counter.lengths
    counter.lengths = lambda texts: seen.append(sum(len(t.encode()) for t in texts)) or encode(texts)
    texts = ["word " * 900, "", "é x" * 50, "tiny"] * 5
    assert counter.counts(iter(texts), len(texts)).tolist() == plain(texts)
    assert len(seen) > 20 and max(seen) < 1200


def test_query_on_documents(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in query(spark, FOLDER).collect()}
    counts = plain(rows.values())
    assert got == {i: (len(t.encode()), n, n > 1024) for (i, t), n in zip(rows.items(), counts)}


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = "lorem ipsum dolor 12ab\n" * 40_000
    rows = [(1, None, "x"), (2, "", "x"), (3, long, None), (4, "a b", "x"), (4, "a b", "x"), (None, "z" * 200_000, "x"), (5, "<|endoftext|>" * 3, "x")]
    out = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, 2)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()))
    want = sorted((i or 0, len((t or "").encode()), n, n > 2) for (i, t, _), n in zip(rows, plain([r[1] for r in rows])))
    assert got == want
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).count() == 0
