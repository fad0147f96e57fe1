"""Names, identifiers and lists held in text."""

from __future__ import annotations

import sys
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two Arrow functions travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words that carry no name, and spellings or local names of a storm.
STOPWORDS = ("TYPHOON", "TROPICAL", "STORM", "CYCLONE", "DEPRESSION", "SEVERE", "SUPER")
ALIASES = {
    "CIRAMON": "CIMARON", "TROPCAL": "TROPICAL", "TOPICAL": "TROPICAL", "TYPHOONN": "TYPHOON",
    "PAENG": "NALGAE", "LABUYO": "UTOR", "YOLANDA": "HAIYAN",
}
# Layouts of administrative-unit ids in free text.
GID_FINE = r"[A-Z]{3}\.[A-Z0-9]+(?:\.[A-Z0-9]+)?_[0-9]"
GID_COARSE = r"[A-Z]{3}\.[A-Z0-9]+(?:_[0-9])?"
NOT_AVAILABLE = "ADMINISTRATIVE UNIT NOT AVAILABLE"


@F.arrow_udf(T.StringType())
def _without_marks(texts: pa.Array) -> pa.Array:
    """Few texts of a batch are Python strings at a time, and what they took is given back."""
    def fold(text):
        return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    folded = pa.concat_arrays([pa.array([], pa.string()), *(
        pa.array([fold(t) for t in texts.slice(at, 64).to_pylist()], pa.string()) for at in range(0, len(texts), 64))])
    pa.default_memory_pool().release_unused()
    return folded


def strip_marks(text: Column | str) -> Column:
    """Compatibility decomposition without combining marks (Spark has no builtin for it); only texts beyond ASCII go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    beyond = F.octet_length(text) > F.length(text)
    return F.when(beyond, _without_marks(F.when(beyond, text))).otherwise(text)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; run it on distinct name pairs after a blocking join."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
                      for x, y in zip(a, b)], dtype="float64")


def squeeze(text: Column) -> Column:
    """Upper case, single spaces, no outer space."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def normalize(text: Column, fold: bool = True) -> Column:
    return squeeze(strip_marks(text)) if fold else squeeze(text)


def tokens(normalized: Column) -> Column:
    """Name tokens of an already normalised text."""
    words = F.split(F.regexp_replace(normalized, r"[\"'()]", " "), r"[^A-Z0-9]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS)
                    & ((F.length(w) > 1) | w.rlike("^[0-9]$")))


def canonical(words: Column) -> Column:
    """Known aliases replaced, stop words that appear by replacement removed."""
    pairs = [F.lit(x) for item in ALIASES.items() for x in item]
    lookup = F.create_map(*pairs)
    return F.filter(F.transform(words, lambda w: F.coalesce(lookup[w], w)),
                    lambda w: ~w.isin(*STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def disaster_base(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{4}-\d{4})", 1), F.lit(""))


def iso_tokens(text: Column) -> Column:
    return F.array_sort(F.array_distinct(
        F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(r"([A-Z]{3})"), 1)))


def split_list(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def cause(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]+", "_")


def json_list(text: Column, schema: str) -> Column:
    """A JSON list, or NULL for anything else."""
    parsed = F.from_json(text, schema)
    return F.when(F.ltrim(text).startswith("["), parsed)


def gids_in_text(text: Column) -> Column:
    """Unit ids named in free text, fine level first."""
    fine = F.regexp_extract_all(text, F.lit(f"({GID_FINE})"), 1)
    coarse = F.regexp_extract_all(text, F.lit(f"({GID_COARSE})"), 1)
    return F.array_distinct(F.concat(fine, coarse))


def storm_label(season: Column, name: Column, number: Column) -> Column:
    return F.concat_ws("_", season, F.replace(name, F.lit(" "), F.lit("_")), number)


def name_in_label(label: Column) -> Column:
    parts = F.split(label, "_")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def joined_set(values: Column) -> Column:
    """Aggregate: sorted distinct non-empty values joined by ';'."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(values), F.lit("")))), ";")
