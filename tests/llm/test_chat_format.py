"""Chat formatting: exact round trips."""

import hashlib

from pyspark.sql import functions as F

from squallframe.llm.chat_format import PART, escape, format_chats, masked_text, parse_turns, text_part, unescape

HARD = ["", "<|im_end|>", "<^|x", "<<^^|", "a\\n\\\\b\n", "<|im_start|>assistant\nhi<|im_end|>\n", "🙂<", "|>", "$1 \\1"]


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").withColumn("parts", text_part(F.col("text")))


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def test_round_trip_with_ties_and_nulls(spark):
    rows = [(1, i, role, t, "x") for i, t in enumerate(HARD) for role in ("user\\n\n<|im_end|>\\", "assistant")]
    rows += [(2, None, None, None, None), (None, 0, "assistant", "a", None), (None, 0, "assistant", "a", None)]
    out = format_chats(chats(spark, rows)).select(
        "conv_id", parse_turns(F.col("formatted")).alias("t"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    want = sorted((i, role, t) for _, i, role, t, _ in rows[:-3])
    assert [(t.role, t.text) for t in got[1].t] == [(role, t) for _, role, t in want]
    assert got[1].loss == "".join(HARD)
    assert [(t.role, t.text) for t in got[2].t] == [("", "")] and got[None].loss == "aa"


def test_parts_are_visited_in_order(spark):
    part = lambda kind, **x: {"kind": kind, **x}
    rows = [(1, 0, "user", [part("text", text="see <|image|> "), part("image", ref="i.png", width=28, height=15),
                            part("audio", ref="a.wav", seconds=1.5), None, part("document", ref="d.pdf", pages=2), part("note", text="!")]),
            (1, 1, "assistant", None)]
    r = format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>")).first()
    assert r.formatted == ("<|im_start|>user\nsee <^|image|> <|image|><|audio|><|document|>!<|im_end|>\n"
                           "<|im_start|>assistant\n<|im_end|>\n")
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 512)]
    assert r.expanded_tokens == 554


def test_empty_table_and_long_text(spark):
    assert format_chats(chats(spark, [])).count() == 0
    long = "word <| " * 20000
    r = format_chats(chats(spark, [(1, 0, "assistant", long, "")])).select(
        F.sha2(masked_text(F.col("formatted"), F.col("loss_spans")).cast("binary"), 256)).first()
    assert r[0] == hashlib.sha256(long.encode()).hexdigest()
