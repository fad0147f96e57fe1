"""Every stage of the pipeline against a plain version on its own input."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_disclosure import BASE
from test_ngram_join import brute as plain_components
from test_packing import check as check_packing
from test_suffix_dedup import brute as plain_removal

from squallframe.llm.disclosure import find_personal_data
from squallframe.llm.mil_quality_query import query as quality_query
from squallframe.llm.shared import stored

FOLDER = "/root/testdata/sf0.001"


def plain_redaction(text, terms):
    spans = [(m.start(), m.end(), k) for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m[0])]
    out, at = "", 0
    for start, end, kind in sorted([*spans, *[(s, e, "term") for s, e in terms]]):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = stored(stages["quality"](spark, docs, FOLDER))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_query(spark, FOLDER).collect() if r.predicted}
    assert 0.5 < kept.count() / len(rows) < 1 and kept.columns == docs.columns

    single = stored(stages["near_duplicates"](spark, kept, FOLDER))
    want = [own for own, n, low in plain_components([(r.doc_id, r.text) for r in kept.collect()]) if own == low or not n]
    assert sorted(r.doc_id for r in single.collect()) == want and single.columns == docs.columns

    cut = stored(stages["repeated_passages"](spark, single, FOLDER))
    removal = plain_removal([(r.doc_id, r.text) for r in single.collect()])
    assert cut.count() == len(want) and cut.columns == docs.columns
    for r in cut.collect():
        assert len(rows[r.doc_id].text.encode()) - removal[r.doc_id][1] - len(r.text.encode()) in range(7) and r.n_chars == len(r.text)
        assert r.text == rows[r.doc_id].text or removal[r.doc_id][1]

    clean = stored(stages["personal_data"](spark, cut, FOLDER))
    terms = {r.doc_id: [(s.start, s.end) for s in r.term] for r in find_personal_data(cut).collect()}
    before = {r.doc_id: r.text for r in cut.collect()}
    assert {r.doc_id: r.text for r in clean.collect()} == {i: plain_redaction(t, terms[i]) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in clean.collect()) and clean.columns == docs.columns

    check_packing(stages["packed"](spark, clean, FOLDER).collect(), {r.doc_id: r.text for r in clean.collect()})


def test_odd_rows_pass(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away from all of it " * 3
    rows = [(1, text, "en", "a", 9, 0.5), (1, text, "en", "a", 9, 0.5), (2, None, None, None, None, None), (3, "", "en", "b", 0, 1.0),
            (None, "mail me at a.b@c.de please", "en", "c", 1, 2.0), (4, text + "word " * 40000, "en", "d", 3, 0.1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {None, 1, 2, 3, 4} and sum(r.doc_id == 1 for r in out) == 1
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_any_further_column_passes(spark):
    names = ["grp", "__doc", "__id", "__spans", "__key", "__row", "__wordless", "quality", "__quality", "c0", "component_id"]
    ddl = "doc_id long, text string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    rows = [(i, f"document {i} " + " ".join(f"w{i}x{j}" for j in range(30)), 0, *range(len(names))) for i in range(4)]
    docs = spark.createDataFrame(rows, ddl)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert all(tuple(r)[3:] == tuple(range(len(names))) for r in out.collect()), name


def test_near_copies_under_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    one, near, other = " ".join(words), " ".join([*words, "end"]), " ".join(reversed(words))
    rows = [(1, one), (5, near), (5, other), (5, other), (None, near + " x"), (None, ""), (None, ""), (None, None), (None, None), (7, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long")
    got = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(1, one), (5, other), (None, ""), (None, ""), (None, None), (None, None), (7, "")], key=str)
