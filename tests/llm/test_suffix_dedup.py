"""Repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from squallframe.llm import suffix_dedup
from squallframe.llm.cover import gram_hashes, least_in_windows, sampled_runs
from squallframe.llm.suffix_dedup import group_column, group_of, tag_column, tag_of, without_repeats
from squallframe.llm.suffix_dedup_query import query

FOLDER = "/root/testdata/sf0.001"


def brute(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for s in range(len(raw) - length + 1):
            if raw[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(raw[s:s + length])
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(rest).hexdigest())
    return out


def told(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choices("abcdeé ", k=n))
    shared = [letters(rng.choice([99, 100, 101, 130, 400])) for _ in range(12)]
    rows = []
    for _ in range(60):
        text = "".join(rng.choice([letters(rng.randrange(200)), rng.choice(shared), rng.choice(shared)[rng.randrange(60):]]) for _ in range(rng.randrange(6)))
        rows.append(text)
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            rows.append(text[:at] + rng.choice(["", "x", "é"]) + text[at + 1:])
    rows += ["a" * 350, "a" * 99, "a" * 100, "ab" * 170, "abc" * 90 + "abd" * 70, "é" * 150, "", rows[0], rows[1], shared[3] * 3]
    rng.shuffle(rows)
    return [(i * 7 - 100, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "COMMON", 20 if seed else 250)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert told(without_repeats(df)) == brute(rows)


def test_query_on_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert told(query(spark, FOLDER)) == brute(rows)


def test_cover_is_consistent():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    other = np.r_[rng.integers(97, 100, 57).astype(np.uint8), raw[400:900]]
    at = {}
    for text in (raw, other):
        for first, last, sample, gram in zip(*sampled_runs(text, 100, 36)):
            for s in range(first, last + 1):
                assert s <= sample <= s + 64
                assert at.setdefault(text[s:s + 100].tobytes(), (sample - s, gram)) == (sample - s, gram)
    assert (least_in_windows(np.arange(10)[::-1], 7) == [3, 2, 1, 0]).all()
    assert gram_hashes(raw, 36)[5] == gram_hashes(raw[5:41], 36)[0] and len(gram_hashes(raw, 36)) == 2965


def test_groups_are_spark_s(spark):
    rows = spark.createDataFrame([(0, "a"), (-7, ""), (2**62, "é🙂"), (-2**63, None)], "i long, t string")
    for r in rows.select("i", "t", tag_column("t").alias("tag"), group_column(F.col("i"), tag_column("t"), 13).alias("g")).collect():
        assert tag_of((r.t or "").encode()) == r.tag and group_of(r.i, r.tag, 13) == r.g


def test_rows_without_an_id_are_spread():
    groups = [group_of(suffix_dedup.NULL_ID, tag_of(str(i).encode()), 50) for i in range(100_000)]
    assert max(np.bincount(groups)) < 1.2 * 2000


def test_any_further_column_passes(spark):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(400))
    names = ["grp", "__doc", "doc", "c0", "c1", "block", "open", "docs"]
    df = spark.createDataFrame([(1, long, *range(8)), (2, "x" + long, *range(8))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = without_repeats(df)
    assert out.columns == [*df.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r.doc_id: (r.text, *[r[n] for n in names]) for r in out.collect()} == {1: (long, *range(8)), 2: ("x", *range(8))}


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 26) + str(i) for i in range(40000))
    rows = [(None, long[:300], 1, "x"), (5, long, 2, "x"), (5, long, 2, "x"), (6, long[1000:1200], 3, "x"), (7, None, 4, None), (8, "", 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, kept_sha256 string")
    out = without_repeats(df)
    got = sorted([(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.text) for r in out.collect()], key=str)
    assert got == sorted([("None", 300, 0, 0, long[:300]), *[("5", len(long), 300, 1, long[300:])] * 2, ("6", 200, 200, 1, ""),
                          ("7", 0, 0, 0, None), ("8", 0, 0, 0, "")], key=str)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert without_repeats(df.filter("false")).count() == 0
