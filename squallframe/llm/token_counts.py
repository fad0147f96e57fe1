"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Texts are cut into pieces and the pieces gathered into batches of about equal bytes, so that one call of the
library holds a bounded number of tokens however long or short the texts are; only numbers leave the function. No row
is shuffled: a scan splits its files by bytes, and a text is counted where it is read.

A long text is cut where its tokens are known to part. A byte-level pre-tokenizer starts a new word at white space
that follows something else, and between an ASCII letter and a digit, whatever stands further away. A special
string holds neither place, so it is never cut. Where a tokenizer works otherwise (``cuts_are_safe``), or a text
has no such place, it is encoded whole.

Defined results: null text is empty text with no tokens; a null id stays null; every row is counted for itself, also
if it repeats another; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import whole_text

#: Characters after which a long text is cut at the next safe place, and bytes of a batch.
PIECE, BATCH_BYTES = 32_768, 262_144
#: Two characters between which words part. The first of the white space case is neither space nor a control character.
SAFE = re.compile(r"[^\s\x00-\x20][ \n]|[A-Za-z][0-9]|[0-9][A-Za-z]")


def cuts_are_safe(settings: dict) -> bool:
    """Whether the places of ``SAFE`` part tokens under these settings (a tokenizer's JSON)."""
    words = settings.get("pre_tokenizer") or {}
    plain = (settings.get("normalizer") is None and words.get("type") == "ByteLevel"
             and words.get("use_regex", True) and not words.get("add_prefix_space", True))
    return plain and all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not re.search(r"[\s0-9]", a["content"])
                         for a in settings.get("added_tokens") or [])


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces, each ending at the first safe place at least ``size`` characters after its start."""
    start = 0
    while len(text) - start > size:
        met = SAFE.search(text, start + size - 1)
        if met is None:
            break
        yield text[start:met.start() + 1]
        start = met.start() + 1
    if start < len(text):
        yield text[start:]


class Counter:
    """A tokenizer that tells lengths; one for each Python worker."""

    held: dict[str, Counter] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task its cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = PIECE if cuts_are_safe(json.loads(self.tokenizer.to_str())) else float("inf")

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: Iterator[str], rows: int) -> np.ndarray:
        """Tokens of each of ``rows`` texts, encoded in batches of about ``BATCH_BYTES``."""
        out, batch, owners, filled = np.zeros(rows, dtype=np.int64), [], [], 0
        for row, text in enumerate(texts):
            for piece in pieces(text, self.size):
                batch.append(piece)
                owners.append(row)
                filled += len(piece) if piece.isascii() else len(piece.encode())
                if filled >= BATCH_BYTES:
                    np.add.at(out, owners, self.lengths(batch))
                    batch, owners, filled = [], [], 0
        if batch:
            np.add.at(out, owners, self.lengths(batch))
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, and whether the tokens exceed ``limit``."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer_path)
        for batch in batches:
            texts = batch.column("text")
            tokens = counter.counts((t.as_py() for t in texts), len(texts))
            yield pa.record_batch([batch.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                                  names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(
        apply, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
