"""Personal data by pattern, and information-theoretic sanitisation of the terms around it.

Base spans come from four patterns. The sanitiser then asks of every word of a document with a
protected value how strongly it reveals that value: P(value | word) over the whole corpus,
from document counts. Words seen with one value in ``support`` different texts or more, of
whose documents at least ``confidence`` hold the value, and whose pointwise mutual
information with it is at least ``bits``, disclose it; they become spans of kind ``term``
wherever they stand, in documents without the value too.

DataFrame functions only. Counts are partial sums before every shuffle; documents are never
grouped by value. Defined results: null text is empty text and has no spans; rows that repeat a
document are each reported; null ids are kept; an empty table gives no rows; columns other than the
id and the text are not read. Time grows with the square of the matches of one kind, and of the marked terms, in one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import numbered, stored, whole_text

#: The base patterns, written so that no start inside a run of their characters is tried twice.
#: They find what ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``,
#: ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, ``[0-9]([\x20-]?[0-9])+`` (13 to 19 digits) and
#: ``\+[0-9][\x20().0-9-]+[0-9]`` find, leftmost and without overlap.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
WORD = r"[\p{L}][\p{L}\p{M}]{2,}"
SPAN = "struct<start:int,end:int,value:string>"


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code point positions: array of (start, end, value)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("at"),
        F.concat(a["spans"], F.array(F.struct(
            (a["at"] + F.length(p["gap"])).alias("start"),
            (a["at"] + F.length(p["gap"]) + F.length(p["value"])).alias("end"), p["value"].alias("value")))).alias("spans"))
    none = F.array().cast(f"array<{SPAN}>")
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])
    return F.when(F.size(found) == 0, none).otherwise(placed)


def luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda d: d != "")
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return {"email": lambda: F.lit(True), "ip": lambda: value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
            "card": lambda: luhn(value), "phone": lambda: digits.between(9, 15)}[kind]()


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind; matches that fail their check are dropped, nothing is tried again."""
    check = lambda kind: lambda s: valid(kind, s["value"])
    return {k: F.filter(find_spans(text, p), check(k)) for k, p in PATTERNS.items()}


def words_of(text: Column) -> Column:
    """The distinct words of a text, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


def term_spans(text: Column, terms: Column) -> Column:
    """Every occurrence of the terms (lower case) among the words of a text: array of (start, end, value)."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    gaps = F.slice(F.split(text, WORD, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(
        F.length(g).alias("gap"), F.length(v).alias("length"), F.lower(v).alias("value")))
    step = lambda a, p: F.struct(
        (a["at"] + p["gap"] + p["length"]).alias("at"),
        F.when(F.array_contains(terms, p["value"]), F.concat(a["spans"], F.array(F.struct(
            (a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["length"]).alias("end"), p["value"].alias("value")))))
        .otherwise(a["spans"]).alias("spans"))
    none = F.array().cast(f"array<{SPAN}>")
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])


def with_base(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, digest of its text, its base spans by kind, its distinct values and, where it has any, its distinct words."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("__text"))
    found = base_spans(F.col("__text"))
    rows = kept.select("doc_id", "__text", F.xxhash64("__text").alias("digest"),
                       *[spans.alias(kind) for kind, spans in found.items()])
    values = F.array_distinct(F.transform(F.concat(*[F.col(k) for k in PATTERNS]), lambda s: F.lower(s["value"])))
    return rows.select("doc_id", "digest", *PATTERNS, values.alias("entities"),
                       F.when(F.size(values) > 0, words_of(F.col("__text"))).alias("words"))


def disclosing_terms(docs: DataFrame, base: DataFrame, text: str = "text", support: int = 3,
                     confidence: float = 0.8, bits: float = 1.0) -> DataFrame:
    """(term, entity) pairs whose co-occurrence in whole documents over the corpus reveals the entity.

    Only words of whose documents the share ``confidence`` holds any value at all are paired with values, as no
    other word can reveal a single one; equal texts are one row with their number.
    """
    frequency = docs.select(F.explode(words_of(whole_text(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    holding = stored(base.filter(F.size("entities") > 0).groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("words").alias("words")))
    entities = (holding.select("copies", F.explode("entities").alias("entity")).groupBy("entity")
                .agg(F.sum("copies").alias("entity_df"), F.count(F.lit(1)).alias("entity_texts"))
                .filter(F.col("entity_texts") >= support).drop("entity_texts"))
    able = (holding.select("copies", F.explode("words").alias("term")).groupBy("term")
            .agg(F.sum("copies").alias("held"), F.count(F.lit(1)).alias("held_texts")).filter(F.col("held_texts") >= support)
            .join(frequency, "term").filter(F.col("held") / F.col("df") >= confidence).select("term", "df"))
    terms = holding.select("digest", "copies", F.explode("words").alias("term")).join(able, "term")
    values = holding.select("digest", F.explode("entities").alias("entity")).join(entities, "entity")
    pairs = (terms.join(values, "digest").groupBy("term", "entity", "df", "entity_df")
             .agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("both"))
             .filter(F.col("texts") >= support))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    scored = (pairs.join(F.broadcast(total))
              .withColumn("revealed", F.col("both") / F.col("df"))
              .withColumn("pmi", F.log2(F.col("revealed") * F.col("total") / F.col("entity_df"))))
    return scored.filter((F.col("revealed") >= confidence) & (F.col("pmi") >= bits)).select("term", "entity", "revealed", "pmi")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """One row per document row: ``doc_id``, ``digest``, the four base kinds and ``term`` spans, wherever a disclosing term stands."""
    base = stored(with_base(docs, doc_id, text))
    terms = stored(disclosing_terms(docs, base, text, **thresholds).select("term").distinct())
    texts = docs.select(F.col(doc_id).alias("__id"), whole_text(text).alias("__text"), F.xxhash64(whole_text(text)).alias("__digest"))
    own_terms = (texts.select("__id", "__digest", F.explode(words_of(F.col("__text"))).alias("term")).join(terms, "term")
                 .groupBy("__id", "__digest").agg(F.collect_set("term").alias("__terms")))
    own_id = F.col("__id").eqNullSafe(F.col("__own")) & (F.col("__digest") == F.col("__same"))
    spans = (texts.join(own_terms.select(F.col("__id").alias("__own"), F.col("__digest").alias("__same"), "__terms"), own_id)
             .dropDuplicates(["__id", "__digest"])
             .select("__id", "__digest", term_spans(F.col("__text"), F.col("__terms")).alias("term")))
    own = F.concat(*[F.col(k) for k in PATTERNS])
    inside = lambda t: F.exists(own, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    none = F.array().cast(f"array<{SPAN}>")
    return (base.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
            .withColumn("term", F.filter(F.coalesce("term", none), lambda t: ~inside(t)))
            .select("doc_id", "digest", *KINDS))


def span_text(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by kind, then start, comma-joined."""
    told = lambda kind: lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.concat(*[F.transform(F.col(k), told(k)) for k in kinds]), ",")


def redact(text: Column, labelled: Column) -> Column:
    """Replace spans (array of start, end, kind) by ``[KIND]``; overlapping ones become one."""
    cut = lambda a, s: F.when(s["start"] < a["at"], F.struct(
        F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.array_sort(labelled), begin, cut,
                       lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """The documents, all their columns kept, with every span generalised to its kind."""
    found = find_personal_data(docs, doc_id, text, **thresholds)
    label = lambda kind: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    labelled = F.concat(*[F.transform(F.col(k), label(k)) for k in KINDS])
    spans = (found.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), labelled.alias("__spans"))
             .filter(F.size("__spans") > 0).dropDuplicates(["__id", "__digest"]))
    own, own_id, own_text = numbered(docs), f"c{docs.columns.index(doc_id)}", f"c{docs.columns.index(text)}"
    joined = own.join(spans, F.col(own_id).eqNullSafe(F.col("__id")) & (F.xxhash64(whole_text(own_text)) == F.col("__digest")), "left")
    clean = F.when(F.col("__spans").isNull(), F.col(own_text)).otherwise(redact(F.col(own_text), F.col("__spans")))
    return joined.withColumn(own_text, clean).select(*own.columns).toDF(*docs.columns)
