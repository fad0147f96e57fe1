import datetime as dt
import difflib
import unicodedata

import pytest
from pyspark.sql import functions as F

from squallframe.functions import calendar as cal
from squallframe.functions import geo, missing
from squallframe.functions import status as st
from squallframe.functions import text as tx


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_years_expressions():
    assert cal.parse_years("2013") == [2013]
    assert cal.parse_years("2000-2003") == [2000, 2001, 2002, 2003]
    assert cal.parse_years("2003, 2001,2001") == [2001, 2003]
    for bad in ("", "2004-2000", ",", "1-2-3"):
        with pytest.raises(ValueError):
            cal.parse_years(bad)
    assert cal.format_years([2002, 2000, 2001]) == "2000-2002"
    assert cal.format_years([2001, 2003]) == "2001,2003"
    assert cal.format_years([2001]) == "2001" and cal.format_years([]) == ""


def test_imputed_dates_in_a_leap_year(spark):
    row = one(spark, cal.imputed_start(F.lit(2012), F.lit(2), F.lit(None).cast("int")).alias("a"),
              cal.imputed_end(F.lit(2012), F.lit(2), F.lit(None).cast("int")).alias("b"),
              cal.imputed_end(F.lit(2013), F.lit(2), F.lit(3)).alias("c"))
    assert (row.a, row.b, row.c) == (dt.date(2012, 2, 1), dt.date(2012, 2, 29), dt.date(2013, 2, 3))
    bad = one(spark, cal.date_of(F.lit(2013), F.lit(2), F.lit(30)), cal.date_of(F.lit(None), F.lit(2), F.lit(3)))
    assert tuple(bad) == (None, None)


def test_dates_in_three_layouts(spark):
    row = one(spark, *[cal.parse_date(F.lit(v)).alias(n) for n, v in
                       zip("abcd", ("2013-11-08", "2013/11/08", "20131108", "never"))])
    assert row.a == row.b == row.c == dt.date(2013, 11, 8) and row.d is None


def test_sentinels_and_nan_are_missing(spark):
    values = [-999.0, -9999.0, -9999.9, float("nan"), float("inf"), None, 0.0, -1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(missing.clean(F.col("v")), missing.nonnegative(F.col("v")),
                                       missing.clamp(missing.clean(F.col("v")), 0.0, 1.0)).collect()]
    assert got == [(None, 0.0, None)] * 6 + [(0.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (2.0, 2.0, 1.0)]


def test_marks_are_stripped_like_unicodedata(spark):
    names = ["Typhoon Ámbar", "ﬁne", "Çağrı", "北京", "plain", None, "é"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = [None if n is None else "".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)) for n in names]
    assert [r[0] for r in df.select(tx.strip_marks("n")).collect()] == want


def test_sequence_ratio_is_difflibs(spark):
    pairs = [("HAIYAN", "HAIYAN YOLANDA"), ("", ""), ("ABC", "XYZ"), ("NALGAE", "NALGE")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(tx.sequence_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_tokens_aliases_and_scores(spark):
    text = F.lit("Super  Typhoon 'Yolanda' (Haiyan) B 2")
    words = tx.canonical(tx.tokens(tx.normalize(text)))
    row = one(spark, words.alias("w"), tx.jaccard(words, F.array(F.lit("HAIYAN"))).alias("j"),
              tx.jaccard(words, F.array().cast("array<string>")).alias("none"))
    assert row.w == ["HAIYAN", "HAIYAN", "2"] and row.j == 0.5 and row.none == 0.0


def test_json_and_ids(spark):
    row = one(spark, tx.json_list(F.lit('[{"gid_1": "A"}]'), "array<struct<gid_1:string>>").alias("a"),
              tx.json_list(F.lit('{"gid_1": "A"}'), "array<struct<gid_1:string>>").alias("b"),
              tx.gids_in_text(F.lit("x PHL.12_1 and PHL.12.3_1")).alias("g"),
              tx.disaster_base(F.lit("2013-0433-PHL")).alias("d"), tx.disaster_base(F.lit("none")).alias("e"),
              tx.split_list(F.lit(" a; b,,c ")).alias("s"), tx.name_in_label(F.lit("2013_A_B_31")).alias("n"))
    assert row.a[0].gid_1 == "A" and row.b is None
    assert {"PHL.12_1", "PHL.12.3_1"} <= set(row.g)
    assert row.d == "2013-0433" and row.e is None and row.s == ["a", "b", "c"] and row.n == "A_B"


def test_longitudes(spark):
    row = one(spark, geo.wrap_180(F.lit(190.0)).alias("a"), geo.wrap_180(F.lit(180.0)).alias("b"),
              geo.negative_to_360(F.lit(-10.0)).alias("c"), geo.negative_to_360(F.lit(200.0)).alias("d"))
    assert (row.a, row.b, row.c, row.d) == (-170.0, -180.0, 350.0, 200.0)


def test_segment_distance(spark):
    def seg(*v):
        return tuple(F.lit(float(x)) for x in v)
    row = one(spark, geo.segment_distance(seg(0, 0, 2, 2), seg(0, 2, 2, 0)).alias("cross"),
              geo.segment_distance(seg(0, 0, 1, 0), seg(0, 3, 1, 3)).alias("apart"),
              geo.segment_distance(seg(5, 0, 5, 0), seg(0, 0, 2, 0)).alias("dot"))
    assert (row.cross, row.apart, row.dot) == (0.0, 3.0, 3.0)


def test_statuses(spark):
    df = spark.createDataFrame([("L0", "PASS"), ("L2", "FAIL"), ("L3", "WARN")], "level string, status string")
    row = df.agg(st.worst(F.col("status")).alias("w"), st.release_decision(F.col("level"), F.col("status")).alias("d")).first()
    assert row.w == "FAIL" and row.d == "Conditional Go"
    gate = df.replace("L2", "L4").agg(st.release_decision(F.col("level"), F.col("status"))).first()
    assert gate[0] == "No Go"
    assert one(spark, st.grade_priority(F.lit(" b ")), st.grade_priority(F.lit("?")))[:] == (1, 4)


def test_only_texts_beyond_ascii_go_to_python(spark):
    def sent(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return sent(node.executedPlan())
        own = node.metrics().get("pythonDataSent")
        return (own.get().value() if own.isDefined() else 0) + sum(sent(node.children().apply(i)) for i in range(node.children().size()))
    rows = [("x" * 5000,)] * 200 + [("é½ﬁ" * 70,)] * 100 + [(None,), ("",)]
    df = spark.createDataFrame(rows, "n string").select(tx.strip_marks("n").alias("n"))
    assert [r.n for r in df.collect()] == ["x" * 5000] * 200 + ["e1⁄2fi" * 70] * 100 + [None, ""]
    assert sent(df._jdf.queryExecution().executedPlan()) < 200_000
