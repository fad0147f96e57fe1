"""Language identification: profiles against a plain version, held-out accuracy."""

import collections

import pytest
from pyspark.sql import functions as F

from squallframe.llm.language_id import learn, ngrams, predict, ranked
from squallframe.llm.language_id_query import query


def plain_ngrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + "".join(w + " " for w in words)
    out = collections.Counter(c for c in padded if c != " ") if words else collections.Counter()
    for i in range(len(padded) - 1 if words else 0):
        out[padded[i:i + 2]] += 1
        if i + 2 < len(padded) and padded[i + 1] != " ":
            out[padded[i:i + 3]] += 1
    return out


@pytest.mark.parametrize("text", ["", "  1 ", "a", "Ab, cd! É", "the  the\nthat", "日本 x🙂y"])
def test_ngrams_match_plain_version(text):
    codes, counts = ranked(ngrams(text), 10**6)
    names = ["".join(chr(int(c) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(c) >> s) for c in codes]
    assert dict(zip(names, counts.tolist())) == dict(plain_ngrams(text))
    assert counts.tolist() == sorted(counts.tolist(), reverse=True)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = query(spark, folder).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the hat", "en")] * 3 + [("der hund und das haus", "de")] * 3)]
    rows += [(10, None, "en"), (11, "12 !?", "en"), (12, "", None), (None, "the hat", "fr"), (13, "the hat", None), (13, "the hat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    profiles = learn(docs, F.lit(True))
    assert profiles.languages == ["de", "en"]
    got = collections.defaultdict(list)
    for r in predict(docs, profiles).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert got[10] == got[11] == got[12] == [("und", 0.0)]
    assert [p for p, _ in got[13]] == ["en", "en"] and got[None][0][0] == "en"
    none = docs.filter("false")
    assert predict(none, learn(none, F.lit(True))).count() == 0
    assert predict(docs, learn(none, F.lit(True))).filter("lang_pred <> 'und'").count() == 0
