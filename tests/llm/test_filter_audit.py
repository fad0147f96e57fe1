"""The audit against plain sets."""

import collections
import itertools
import random
import re
from pathlib import Path

import numpy as np
import pytest
from compare import compare, connect

from squallframe.llm import filter_audit
from squallframe.llm.filter_audit import both, merged, orders, sizes, without
from squallframe.llm.filter_audit_query import NAME, SQL, audit, query

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(30))
def test_merges_are_set_operations(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(60), rng.choice([0, 1, 5, 40]))) for _ in range(4)]
    a, b = lists[:2]
    na, nb = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    assert both(na, nb) == len(set(a) & set(b))
    assert without(na, nb).tolist() == sorted(set(a) - set(b))
    assert merged(na, nb).tolist() == sorted(set(a) | set(b))
    table = sizes([np.array(x, dtype=np.int64) for x in lists[:3]], [np.array(lists[3], dtype=np.int64)])
    for i, before, out, gone, marked in table.tolist():
        prior = set().union(*[lists[j] for j in range(3) if before >> j & 1])
        assert (out, gone, marked) == (len(prior | set(lists[i])), len(set(lists[i]) - prior), len((set(lists[i]) - prior) & set(lists[3])))
    assert len(table) == 12


def test_orders():
    assert len(orders(list("ABCDE"))) == 600
    assert orders(["A", "B"]) == [("AB", 1, 0, 0), ("AB", 2, 1, 1), ("BA", 1, 1, 0), ("BA", 2, 0, 2)]


def brute(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[at] == 1} for at in (0, 1))
    least, parts = {}, collections.defaultdict(list)
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ((len(words) < 100) * "A" + (100 * len(set(words)) < 80 * len(words)) * "B" + (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) * "C"
                 + bool(re.search("[#$%&*|]", t)) * "D" + (i is not None and least[t] < i) * "E")
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        removed, steps = collections.Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                prior = set(order[:step - 1])
                gone = [r for r in rows if f in r[0] and not prior & set(r[0])]
                removed[f] += len(gone)
                steps.append((part, order, step, sum(not (prior | {f}) & set(r[0]) for r in rows), len(gone), sum(f in r[0] for r in rows) - len(gone),
                              sum(r[0] == f for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*s, removed[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_odd_rows_against_plain_sets(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE", 1)  # many small ranges
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, None, "en"), (2, "", "en"), (3, "", None), (4, long, ""), (5, long, "en"), (5, long, "en"), (None, long, "en"), (None, None, "de"),
            (6, "AB " * 150, "de"), (7, "a#b " * 120, "de"), (7, "plain", "de"), (8, "\x0b\x1c \x85x", "fr"), (9, "É É", "fr")] + [(i, "same text", "hot") for i in range(20, 60)]
    labels = [(1, 1, 0), (2, None, 1), (5, 1, 1), (5, 0, 0), (None, 1, 1), (30, 1, 0), (7, 0, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, removed int")
    out = audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out.collect()) == brute(docs, labels)
    assert audit(frame.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_query_matches_sql(spark):
    assert compare(query(spark, FOLDER), connect(FOLDER), SQL) is None
    assert NAME.startswith("op11_") and Path(FOLDER).exists()
