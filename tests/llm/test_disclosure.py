"""Personal data spans against Python's own regular expressions, and disclosure on planted words."""

import hashlib
import re

from pyspark.sql import functions as F

from squallframe.llm.disclosure import KINDS, find_personal_data, sanitise, span_text
from squallframe.llm.disclosure_query import query

FOLDER = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(value):
    return re.sub("[^0-9]", "", value)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
}


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m[0])]


TRICKY = [
    None, "", "a@b.c_d@e.f x.y@z", "a@b.c.d.e@f.g@h.i", "ü@x.y é.a@b-c.de", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.002.003.0255", "1.2.3.4444",
    "4111 1111 1111 1111", "5--4111-1111-1111-1111", "41111111111111111111111", "5 4111 1111 1111 1111 x4111111111111111",
    "+1 (415) 555-2671.", "+12 +14155552671 +1 2", "🙂 mail a@b.co 🙂 +49 30 1234567", "aaaa@ @b.c a@@b.c", "+1 4111 1111 1111 1111",
    "x" * 5000 + "@", "1" * 5000, "a.b" * 3000 + "@q.w" + ".z" * 3000, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9",
]


def test_base_spans_match_python(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    found = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r[0]: r[1] for r in found.select("doc_id", span_text(KINDS[:4])).collect()}
    for i, t in rows:
        assert got[i] == ",".join(base(t or "")), t


def test_query_matches_python(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = query(spark, FOLDER).collect()
    assert len(out) == len(texts)
    for r in out:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.spans == ",".join([*want, *[s for s in r.spans.split(",") if s.startswith("term:")]])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]


def test_disclosing_words(spark):
    rows = [(i, f"note {i} the plumber Zarquon wrote a.b@c.de about {i} things", "e") for i in range(4)]
    rows += [(10 + i, f"the plumber about and things wrote {i}", "e") for i in range(8)]
    docs = spark.createDataFrame([*rows, rows[0], (None, None, None)], "doc_id long, text string, digest string")
    found = {(r.doc_id): r for r in find_personal_data(docs).collect()}
    assert [s.value for s in found[0].term] == ["note", "zarquon"] and found[10].term == [] and found[None].term == []
    assert find_personal_data(docs).count() == 14
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert clean[1] == "[TERM] 1 the plumber [TERM] wrote [EMAIL] about 1 things" and clean[10] == rows[4][1] and clean[None] is None
    assert sanitise(docs).columns == docs.columns


def test_empty_table(spark):
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).select(F.count("*")).first()[0] == 0


def test_any_further_column_passes(spark):
    names = ["__id", "__spans", "__digest", "digest", "term", "c0", "c1", "email"]
    df = spark.createDataFrame([(1, "to a.b@c.de", *range(8)), (2, None, *range(8))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = sanitise(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, *[r[n] for n in names]) for r in out.collect()} == {1: ("to [EMAIL]", *range(8)), 2: (None, *range(8))}


def test_terms_far_from_the_value(spark):
    far = "and so on " * 30
    rows = [(i, f"Zarquon {i} {far} a.b@c.de {far} {i} zarquon's") for i in range(4)] + [(9, f"only ZARQUON here {far}")]
    rows += [(10 + i, f"here only and so {i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.term] for r in find_personal_data(docs).collect()}
    want = {i: [m.span() for m in re.finditer("(?i)zarquon", t)] for i, t in rows}
    assert found == want and len(want[0]) == 2 and len(want[9]) == 1
    assert {r.doc_id: r.text for r in sanitise(docs).collect()}[9] == f"only [TERM] here {far}"


def test_terms_match_plain_counts(spark):
    rows = [(i, f"kept{'x' * (i % 3)} Ünder🙂 {'rare' if i % 4 else 'oft'} {'q.r@s.tu' if i % 5 else 'a@b.cd'} word {'odd' * (i % 2)}") for i in range(40)]
    rows += [(i, "oft word plain") for i in range(40, 90)] + [rows[3], (None, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [(t, {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}, set(re.findall(BASE["email"][0].replace("(", "(?:"), t))) for _, t in rows]
    want = set()
    for word in set().union(*[w for _, w, _ in held]):
        for value in ("q.r@s.tu", "a@b.cd"):
            both = [t for t, w, v in held if word in w and value in v]
            share = len(both) / sum(word in w for _, w, _ in held)
            rate = share * len(rows) / max(1, sum(value in v for _, _, v in held))
            if len(set(both)) >= 3 and share >= 0.6 and rate >= 2:
                want.add(word)
    got = find_personal_data(docs, confidence=0.6).collect()
    assert want and {s.value for r in got for s in r.term} == want and len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        assert [(s.start, s.end) for s in r.term] == [m.span() for m in re.finditer(r"[^\W\d_]{3,}", text) if m[0].lower() in want]
