"""Jaccard components against brute force."""

import random
import re

import numpy as np
import pytest

from squallframe.llm import ngram_join
from squallframe.llm.components import components
from squallframe.llm.ngram_join import similarity_components
from squallframe.llm.shingles import shingle_set


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                lead[find(i)] = find(j)
    low = {}
    for i, (own, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), own), own)
    return sorted((own, len(sets[i]), low[find(i)]) for i, (own, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line, out = " ".join(rng.choices(words, k=12)), []
    for _ in range(25):
        text = rng.choices(words, k=rng.choice([3, 5, 6, 20, 60, 150]))
        out.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            copy = text[:]
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                at = rng.randrange(len(copy))
                copy[at:at + rng.choice([0, 1])] = [rng.choice(words)]
            out.append(" ".join(copy) if rng.random() < 0.8 else "\t".join(copy).upper())
    out += [line] * 9 + [f"{line} {i} x y z" for i in range(9)] + ["", " \n", "a", "a", "A b", "É é", "é é"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, similarity_components(df).collect())) == brute(rows)


def test_shingle_sets_count_distinct_shingles():
    for text in ("", "a b c", "a b c d e f a b c d e f", "A  b\tC\nd\x0be é", "x y"):
        assert len(shingle_set(text)) == len(plain_set(text))
    assert (shingle_set("A b c d E") == shingle_set("a B\x0bc  d e")).all()
    assert not np.intersect1d(shingle_set("a b"), shingle_set("ab")).size


def test_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"v{i % 4999}" for i in range(30000))
    rows = [(None, "p q r s t u", 0), (7, "p q r s t u", 0), (7, "p q r s t u", 0), (8, None, 0), (9, "", 0), (3, long, 0), (2, long + " end", 0), (None, "only", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(map(str, map(tuple, similarity_components(df).collect())))
    assert got == sorted(map(str, [(None, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8), (9, 0, 9), (3, 4999, 2), (2, 5000, 2), (None, 1, None)]))
    assert similarity_components(df.filter("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(100, 200), (300, 200), (500, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 71)}, 100: 100, 200: 100, 300: 100, 500: 500}
