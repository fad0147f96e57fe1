"""The corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a frame that is
written and read again as the next one's documents. Texts that change get their new ``n_chars``. Rows of
null text or null id, repeated rows and further columns pass through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.llm.disclosure import sanitise
from squallframe.llm.mil_quality import learn, score
from squallframe.llm.mil_quality_query import THRESHOLD
from squallframe.llm.ngram_join import similarity_components
from squallframe.llm.packing_query import packed_documents
from squallframe.llm.shared import crc_fold, numbered, stored, whole_text
from squallframe.llm.suffix_dedup import without_repeats


def named(docs: DataFrame, column: str) -> str:
    """A column's name in ``numbered``."""
    return f"c{docs.columns.index(column)}"


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the present text."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the attention model scores at the threshold or above."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model, own = learn(docs, labels, crc_fold("doc_id", 5) != 0), numbered(docs)
    scored = score(own, model, doc_id=named(docs, "doc_id"), text=named(docs, "text"), out="quality")
    return scored.filter(F.col("quality") >= THRESHOLD).select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of linked documents, of its texts the one of the smallest digest; documents without
    words are linked with nothing and all stay."""
    doc_id, text = named(docs, "doc_id"), named(docs, "text")
    keyed = numbered(docs).withColumn("__key", F.xxhash64(doc_id, whole_text(text)))
    groups = similarity_components(keyed.select(F.col("__key").alias("doc_id"), F.col(text).alias("text"))).distinct().withColumnRenamed("doc_id", "__key")
    ids = keyed.select("__key", F.col(doc_id).alias("doc_id")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key"))
    leads = (groups.filter("n_shingles > 0").join(ids, "__key").groupBy("component_id").agg(first.alias("lead"))
             .select(F.col("lead.__key").alias("__key"), F.lit(False).alias("__wordless")))
    stay = leads.unionByName(groups.filter("n_shingles = 0").select("__key", F.lit(True).alias("__wordless")))
    return (keyed.join(stay, "__key").withColumn("__row", F.when(F.col("__wordless"), F.monotonically_increasing_id()))
            .dropDuplicates([doc_id, text, "__row"]).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that stand earlier in the corpus."""
    return counted(without_repeats(docs), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it generalised."""
    return counted(sanitise(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every token piece of every document in the training sequences."""
    return packed_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("personal_data", personal_data), ("packed", packed)]

#: Learnt scores and token ids have no SQL; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
