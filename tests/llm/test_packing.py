"""Packing: exact ids, gapless sequences, few sequences, and the reduction against brute force."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from squallframe.llm.packing import Lengths, best_fit, lower_bound, plan, reduce_by_dominance
from squallframe.llm.packing_query import CAPACITY, packed_documents, query
from squallframe.llm.token_pieces import WordTokenizer

FOLDER, PATH = "/root/testdata/sf0.001", public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    """Fewest sequences by exhaustive search."""
    best = [len(items)]

    def go(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(items):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= items[at] and rooms[i] not in rooms[:i]:
                go(at + 1, rooms[:i] + [rooms[i] - items[at]] + rooms[i + 1:])
        go(at + 1, [*rooms, capacity - items[at]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_never_costs_a_sequence(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    items = sorted((rng.randint(1 + capacity // rng.choice([2, 3, 4, 9]), capacity) for _ in range(9)), reverse=True)
    left = Lengths(collections.Counter(items))
    fixed = reduce_by_dominance(left, capacity)
    rest = sorted((s for s, n in left.count.items() for _ in range(n)), reverse=True)
    assert sum(n for n, _ in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity)
    assert all(sum(p) <= capacity for _, p in fixed)
    assert sorted([*rest, *itertools.chain(*[p * n for n, p in fixed])], reverse=True) == items


def test_best_fit_matches_piece_by_piece():
    rng = random.Random(3)
    items = sorted((rng.randint(1, 60) for _ in range(400)), reverse=True)
    rooms = []
    for item in items:
        fits = [i for i, r in enumerate(rooms) if r >= item]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= item
        else:
            rooms.append(100 - item)
    assert sum(n for n, _ in best_fit(Lengths(collections.Counter(items)), 100)) == len(rooms)


def test_plan_holds_every_piece():
    counts = {4096: 5, 4000: 3, 96: 7, 1000: 10, 1: 4, 2048: 3}
    table = plan(counts, 4096)
    assert table.sequence.min() == 0 and set(table["length"]) == set(counts)
    assert lower_bound(counts, 4096) <= 14
    assert plan({}, 4096).empty


def test_word_ids_are_the_tokenizer_s():
    texts = ["", " ", "Don't, STOP. e.g. a,b.c", "É ÉA. Ünïx, İΣΑΣ. ß.", "x" * 300 + ".", "<|endoftext|> a<|endoftext|>b", "12,34. 's 'S we'll.",
             "á b́.\n\n\tc d\r\ne", "🙂. 日本語, ﬁn.", "..., a.. b.,", "퟿　x", "naïve naïve. Naïve, NAÏVE"]
    mine, plain = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for text in texts + texts:
        assert np.frombuffer(mine.ids([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def check(rows, texts):
    plain, by = Tokenizer.from_file(PATH), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for own, held in by.items():
        ids = np.array([*plain.encode(texts[own] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        held.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in held] == [(i, at, len(ids[at:at + CAPACITY])) for i, at in enumerate(range(0, len(ids), CAPACITY))]
        assert [r.ids_crc32 for r in held] == [zlib.crc32(ids[at:at + CAPACITY].tobytes()) for at in range(0, len(ids), CAPACITY)]
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert len(sequences) <= 1.01 * lower_bound(collections.Counter(r.length for r in rows), CAPACITY) + 1


def test_query_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    check(query(spark, FOLDER).collect(), texts)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "word " * 9000, 5), (4, "a b", 5), (4, "a b", 5), (None, "z", 5)]
    out = packed_documents(spark.createDataFrame(rows, "doc_id long, text string, length int")).collect()
    assert collections.Counter(r.doc_id for r in out) == {1: 1, 2: 1, 3: 3, 4: 2, None: 1}
    assert sorted((r.sequence_id, r.offset) for r in out if r.doc_id == 4) == sorted({(r.sequence_id, r.offset) for r in out if r.doc_id == 4})
    assert packed_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_common_words_stay_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr("squallframe.llm.token_pieces.REMEMBERED", 50)
    mine, plain = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    rng, seen = random.Random(5), []
    for part in range(6):
        rare = ["".join(rng.choices("abcdeéßñ", k=9)) for _ in range(40)]
        texts = [f"the Storm, of {w} the" for w in rare]
        for text, ids in zip(texts, mine.ids(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
        seen += rare
        assert {"the", "Storm,", "of"} <= set(mine.known) and not mine.known.missed
    texts = ["the of"]
    mine.ids(texts)
    assert set(mine.known) == {"the", "of"}  # the memory was full: of what it held, the words at hand are left
