"""I-Match fingerprints: the edit and the order exactly, the lexicon and slots against a plain version."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from squallframe.llm import imatch
from squallframe.llm.imatch import lexicon, range_bounds, with_next
from squallframe.llm.imatch_query import fingerprinted, query

FOLDER = "/root/testdata/sf0.001"


def edit(texts):
    """(id, edited text) in order."""
    out = []
    for i, (own, text) in enumerate(texts):
        half, after = len(text) // 2, texts[(i + 1) % len(texts)][1]
        out.append((own, text[:len(text) - half] + after[:half]))
    return out


def test_query_on_documents(spark):
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]
    rows = {r.doc_id: r for r in query(spark, FOLDER).collect()}
    assert len(rows) == len(texts)
    edited = dict(edit(texts))
    prints = {}
    for own, text in texts:
        r = rows[own]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited[own].encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    mean = lambda name: sum(r[name] for r in rows.values()) / len(rows)
    assert mean("near_edited") > mean("near_next") + 0.1


def test_lexicon_matches_plain_version(spark):
    rows = [(0, "a b c c x"), (1, "B c d"), (2, "c e"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    kept = {r.term for r in lexicon(docs, band=(0.2, 0.4)).collect()}
    df = collections.Counter(t for _, text in rows for t in set(re.findall(r"\w+", (text or "").lower())))
    assert kept == {t for t, n in df.items() if n <= 2}


def test_slots_match_plain_version(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RATES", (1, 2, 2, 4096))
    docs = spark.createDataFrame([(0, "a b c c x", "x"), (1, "", None)], "doc_id long, text string, other string")
    words = spark.createDataFrame([("a", 0), ("b", 4096), ("x", 8192)], "term string, hash long")
    got = {r.doc_id: r for r in imatch.fingerprints(docs, ["doc_id"], words, ["text", "other"]).select(
        "*", *[F.xxhash64(F.array(*[F.lit(h).cast("long") for h in hs])).alias(n) for n, hs in (("abx", (0, 4096, 8192)), ("ax", (0, 8192)), ("b", (4096,)), ("x", (8192,)))]).collect()}
    r = got[0]
    # bits 0-11 decide the first rate, bits 12-23 the second, bits 24-35 the third
    assert r.text == [r.abx, r.ax, r.b, r.abx] and r.other == [r.x, r.x, None, r.x]
    assert got[1].text == got[1].other == [None] * 4


def test_next_over_many_ranges(spark):
    ids = [-5, 3, 3, 4, 8, 100, 1000, 2**60]
    rows = [(i, i // 3, f"t{i}") for i in ids] + [(3, 7, "u")]
    df = spark.createDataFrame(rows, "id long, key long, text string").repartition(3)
    order = sorted(set(rows))
    for bounds in ([], [3], [4, 9], [-9, -5, 3, 4, 8, 99, 100, 2**61], range_bounds(df, "id", 4)):
        got = {(r.id, r.key, r.text): (r.next_id, r.next_key, r.next_text) for r in with_next(df, bounds).collect()}
        assert got == dict(zip(order, order[1:] + order[:1])), bounds


def test_odd_rows(spark):
    rows = [(None, "z y", "k"), (1, None, "k"), (2, "word " * 20000, "k"), (2, "word " * 20000, "k"), (3, "ü🙂é", "k"), (4, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    rows = fingerprinted(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert collections.Counter(r.doc_id for r in rows) == {None: 1, 1: 1, 2: 2, 3: 1, 4: 1}
    want = dict(edit([(None, "z y"), (1, ""), (2, "word " * 20000), (3, "ü🙂é"), (4, "")]))
    assert {k: r.edited_sha256 for k, r in got.items()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert got[4].near_edited == got[1].near_edited == 1.0
    assert fingerprinted(docs.filter("false")).count() == 0
    one = fingerprinted(docs.filter("doc_id = 3")).first()
    assert one.near_next == 1.0


def test_texts_outside_the_lexicon(spark):
    rows = [(i, t) for i, t in enumerate(["often x", "often y", "y often", "often", "", "a b"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = spark.createDataFrame([("a", 8)], "term string, hash long")
    got = {r.doc_id: r.text for r in imatch.fingerprints(docs, ["doc_id"], words, ["text"]).collect()}
    assert got[1] == got[2] and len({tuple(got[i]) for i in (0, 1, 3, 4, 5)}) == 5
    assert got[4] == [None] * len(imatch.RATES) and None not in got[0]
