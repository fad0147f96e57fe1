"""Documents as token pieces of bounded length."""

from __future__ import annotations

import codecs
import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import giving_back, whole_text

#: Words whose ids a Python worker remembers, and the longest it does.
REMEMBERED, LONGEST = 450_000, 64
#: Characters of the texts whose words are looked up and learnt at a time.
PART = 1_500_000


def leaves_plain_words(settings: dict) -> bool:
    """Whether a tokenizer's steps before the merges keep a lower-case word of letters as it is, as one word of its bytes."""
    steps = [n["type"] for n in (settings.get("normalizer") or {}).get("normalizers", [])]
    split = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (set(steps) <= {"NFC", "Replace", "Lowercase"} and [s["type"] for s in split] == ["Split", "ByteLevel"]
            and "[\\p{L}]+" in split[0]["pattern"].get("Regex", "").split("|"))


def words_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


class Known(dict):
    """Ids by word; a word that is not there is noted in ``missed`` and stands for itself."""

    def __init__(self, *held):
        super().__init__(*held)
        self.missed: dict[str, None] = {}

    def __missing__(self, word: str) -> str:
        self.missed[word] = None
        return word


class WordTokenizer:
    """Ids of whole texts, word by word, for a tokenizer that drops white space and marks word ends.

    Such a tokenizer never joins across a space or line feed, so a text's ids are those of its
    words in order, and most words have been seen before. A new word of letters, with or without a
    full stop or comma behind it, takes the ids of its lower case; new lower-case words are
    encoded in one call, whose ids fall apart at the word ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.plain, self.spelt = self.tokenizer, ""
        if leaves_plain_words(settings):
            # What normalising and splitting would do to lower-case words of letters is nothing: only the merges are left.
            # The characters that their bytes stand for are put in beforehand.
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            spelt = {b: c for x in map(chr, range(0x80, 0x100)) if x.isalpha() for b, c in zip(x.encode(), as_bytes.pre_tokenize_str(x)[0][0])}
            self.spelt = "".join(spelt.get(b, chr(b)) for b in range(0x100))
        suffix = settings["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
        self.suffix = suffix
        self.known = Known()

    def encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(f.ids, dtype="<u4").tobytes() for f in found]

    def learn_plain(self, words: list[str]) -> None:
        """Lower-case words of letters, each one pre-token."""
        if self.suffix and words:
            text = " ".join(words)
            if self.spelt:
                text = codecs.charmap_decode(text.encode(), "strict", self.spelt)[0]
            ids = np.asarray(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(words) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for word, cut in zip(words, (4 * cuts).tolist()):
                    self.known[word] = raw[at:cut]
                    at = cut
                return
        self.known.update(zip(words, self.encode(words)))

    def learn(self, words: list[str]) -> None:
        known, plain, other, derived = self.known, {}, [], []
        for word in words:
            core, tail = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
            if core.isalpha() and (core.isascii() or max(core) < "\u0100") and len(core) <= LONGEST:
                low = core.lower()
                if low not in known:
                    plain[low] = None
                if low != word:
                    derived.append((word, low, tail))
            else:
                other.append(word)
        self.learn_plain(list(plain))
        known.update(zip(other, self.encode(other)))
        for word, low, tail in derived:
            if tail and tail not in known:
                known[tail] = self.encode([tail])[0]
            known[word] = known[low] + (known[tail] if tail else b"")

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; what is new in any of them is learnt at once."""
        if len(self.known) > REMEMBERED:  # common words are among those at hand, so these are kept
            used = set(chain.from_iterable(map(words_of, texts)))
            self.known = Known({w: self.known[w] for w in used if w in self.known})
        known = self.known
        found = [list(map(known.__getitem__, words_of(text))) for text in texts]
        new, known.missed = known.missed, {}
        if new:
            self.learn(list(new))
            found = [[known[x] if type(x) is str else x for x in one] for one in found]
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        return list(map(b"".join, found))


def parts(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in lists of about ``PART`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > PART:
            yield held
            held, size = [], 0
    if held:
        yield held


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which keeps what it has learnt from task to task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Null text is empty: the end id alone.

    A document is one piece unless it has more than ``capacity`` ids. Rows that repeat a document
    are cut each for itself; a null doc_id stays null. Texts stay whole in one task, one at a time.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        for batch in batches:
            owns, texts = batch.column("doc_id"), batch.column("text")
            whole = (t for at in range(0, len(texts), 64) for t in texts.slice(at, 64).to_pylist())
            row, places = 0, []
            for held in parts(whole):
                for ids in tokenizer.ids(held):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        places.append((row, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                    row += 1
            rows, piece, start, length, crc = np.asarray(places, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([owns.take(pa.array(rows)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(
        giving_back(apply), "doc_id long, piece int, start long, length long, ids_crc32 long")
