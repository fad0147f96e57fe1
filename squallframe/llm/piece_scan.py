"""SentencePiece unigram encoding and decoding as a max-plus parallel scan.

The best segmentation of a text is the shortest path over its positions, a product of matrices in the (max, +)
semiring. A long text is cut into chunks. The state at a cut is how many characters the piece
across it reaches into the next chunk, below the longest piece's length L, so a chunk is an L x L matrix of best
scores from entry to exit state. Matrices combine associatively: products by doubling give the entry scores
of every chunk. With them each chunk finds, by itself, which entry leads to each exit; these maps compose backwards
to the exit of every chunk, which then traces its own pieces.

Where no piece can cross a cut, its state is 0 alone and the chunks are independent. With a vocabulary whose
pieces hold the word mark at their beginning only this is so before every word, and cuts are made there
if there is one. Only chunks cut elsewhere, within an unbroken run of ``CHUNK`` characters, need matrices.

Scores are integers, so sums are exact at any length; equal scores go to the piece that starts
first, as in a pass from left to right.

Defined results: null and empty texts have no pieces; characters without a piece become their UTF-8 bytes, or the
unknown id where the vocabulary has no bytes; a literal word mark reads back as a space; rows that repeat are each
answered; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import giving_back, hash_slots, stored, whole_text
from .token_pieces import parts

MARK = "▁"
#: Characters in a chunk, words a worker remembers and the longest it does.
CHUNK, REMEMBERED, LONGEST = 65_536, 200_000, 64
#: Characters that end words; they are encoded apart where no piece holds them together with the letter before.
TAIL = ".,;:!?|"
NEVER = -2**60


@dataclass
class UnigramModel:
    """Pieces with integer scores; ids of bytes for characters without a piece."""

    pieces: dict[str, tuple[int, int]]
    byte_ids: list[int]
    unknown_id: int
    texts: list[bytes]
    unknown_score: int = 0
    library: object = None
    known: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.unknown_score = min((s for s, _ in self.pieces.values()), default=0) - 640
        self.longest = max(map(len, self.pieces), default=1)
        self.by_first: dict[str, int] = {}
        for piece in self.pieces:
            self.by_first[piece[0]] = max(self.by_first.get(piece[0], 0), len(piece))
        self.adjacent = {p[i:i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.words_part = all(MARK not in p.lstrip(MARK) for p in self.pieces)

    @classmethod
    def from_file(cls, path: str) -> UnigramModel:
        """The pieces of a model file in its order, scored by Zipf's law: -round(64 * ln(2 + place))."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        given = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, texts = {}, [0] * 256, []
        for i in range(given.get_piece_size()):
            piece = given.id_to_piece(i)
            if given.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif given.is_control(i) or given.is_unknown(i) or given.is_unused(i):
                texts.append(b"" if given.is_control(i) else " ⁇ ".encode())
            else:
                pieces[piece] = (-round(64 * float(np.log(2 + len(pieces)))), i)
                texts.append(piece.replace(MARK, " ").encode())
        proto = sentencepiece_model_pb2.ModelProto.FromString(given.serialized_model_proto())
        proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
        for piece in proto.pieces:
            if piece.piece in pieces:
                piece.score = pieces[piece.piece][0]
        library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        return cls(pieces, byte_ids if any(byte_ids) else [], given.unk_id(), texts, library=library)

    def forward(self, text: str, size: int, entry: list[int]) -> tuple[list[int], list[int]]:
        """Best scores of the positions of ``text`` for pieces that start before ``size``, and where their last piece starts.

        ``entry``: scores with which its first positions are reached from before; those have start -1.
        """
        n = len(text)
        best, back = [NEVER] * (n + 1), [-1] * (n + 1)
        best[:len(entry)] = entry[:n + 1]
        pieces, by_first = self.pieces, self.by_first
        for at in range(min(size, n)):
            base = best[at]
            if base <= NEVER // 2:
                continue
            single = False
            for end in range(at + 1, min(n, at + by_first.get(text[at], 0)) + 1):
                found = pieces.get(text[at:end])
                if found is not None:
                    single |= end == at + 1
                    if base + found[0] > best[end]:
                        best[end], back[end] = base + found[0], at
            if not single and base + self.unknown_score > best[at + 1]:
                best[at + 1], back[at + 1] = base + self.unknown_score, at
        return best, back

    def trace(self, text: str, back: list[int], end: int) -> tuple[int, list[int]]:
        """Position at which the path to ``end`` enters, and its ids."""
        cuts = [end]
        while cuts[-1] > 0 and back[cuts[-1]] >= 0:
            cuts.append(back[cuts[-1]])
        ids: list[int] = []
        for a, b in zip(cuts[:0:-1], cuts[-2::-1]):
            found = self.pieces.get(text[a:b])
            ids += [found[1]] if found else [self.byte_ids[x] for x in text[a:b].encode("utf-8", "replace")] if self.byte_ids else [self.unknown_id]
        return cuts[-1], ids

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best scores from entry state to exit state of a chunk of ``size`` characters, followed by what ``text`` holds beyond."""
        out = np.full((self.longest, self.longest), NEVER, dtype=np.int64)
        for i in range(self.longest):
            best = self.forward(text, size, [NEVER] * i + [0])[0][size:size + self.longest]
            out[i, :len(best)] = best
        return np.maximum(out, NEVER)

    def word(self, word: str) -> bytes:
        return np.asarray(self.trace(word, self.forward(word, len(word), [0])[1], len(word))[1], dtype="<u4").tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Ids of new words. A mark and what follows it is what the library's own unigram encoder makes of the rest: with these scores, sums of
        words of at most ``LONGEST`` characters are exact in its floats."""
        known, parts, ends = self.known, {}, []
        for w in words:
            core = w.rstrip(TAIL)
            if core and core != w and core[-1] + w[len(core)] not in self.adjacent:
                tail = w[len(core):]
                parts[core] = parts[tail] = None
                ends.append((w, core, tail))
            else:
                parts[w] = None
        fresh = [p for p in parts if p not in known]
        plain = [p for p in fresh if p[0] == MARK and 1 < len(p) <= LONGEST and MARK not in p[1:]] if self.library else []
        for p, ids in zip(plain, self.library.encode([p[1:] for p in plain], num_threads=1) if plain else []):
            known[p] = array("I", ids).tobytes()
        for p in fresh:
            if p not in known:
                known[p] = self.word(p)
        for w, core, tail in ends:
            known[w] = known[core] + known[tail]

    def encode(self, marked: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of texts between cuts that no piece crosses; what is new in any of them is learnt at once."""
        if not self.words_part:
            return [self.word(m) for m in marked]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [split_words(m) for m in marked]
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in known]
        self.learn(new)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
                known.pop(w.rstrip(TAIL), None)
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.texts.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def marked_text(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def split_words(marked: str) -> list[str]:
    """Cut before every run of word marks; a run stays with the word behind it."""
    parts = marked.split(MARK)
    words = [parts[0]] if parts[0] else []
    marks = 0
    for part in parts[1:]:
        marks += 1
        if part:
            words.append(MARK * marks + part)
            marks = 0
    if marks:
        words.append(MARK * marks)
    return words


def cut_chunks(marked: str, model: UnigramModel, chunk: int) -> list[tuple[str, str, bool, bool]]:
    """(chunk, what a piece may reach beyond it, whether a piece may cross its start, its end)."""
    out, at, soft_in, n = [], 0, False, len(marked)
    while at < n:
        end, soft = min(n, at + chunk), False
        if n - end < model.longest:
            end = n
        elif end < n:
            cut = marked.rfind(MARK, at + 1, end + 1) if model.words_part else -1
            while cut > at and marked[cut - 1] == MARK:
                cut -= 1
            end, soft = (cut, False) if cut > at and (cut - at >= model.longest or not soft_in) else (end, True)
        out.append((marked[at:end], marked[end:end + model.longest - 1] if soft else "", soft_in, soft))
        at, soft_in = end, soft
    return out


_MODELS: dict[str, UnigramModel] = {}


def model_of(path: str) -> UnigramModel:
    """One for each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = UnigramModel.from_file(path)
    return _MODELS[path]


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Associative product; impossible stays impossible."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Inclusive prefix products, by doubling."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [max_plus(out[i - step], out[i]) if i >= step else out[i] for i in range(len(out))]
        step *= 2
    return out


KEY = ["doc_id", "tag", "copy"]


def soft_paths(soft: DataFrame, path: str) -> DataFrame:
    """Ids of the chunks that pieces may cross into or out of: scan of matrices, composed exits, own traces."""
    keys = "doc_id long, tag long, copy long, idx int, run int"

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [model_of(path).matrix(t + a, len(t)).tobytes() if out else None for t, a, out in zip(b["chunk"], b["ahead"], b["soft_out"])]
            yield b[[*KEY, "idx", "run"]].assign(matrix=made)

    def entries(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        side = model_of(path).longest
        begin = np.r_[0, np.full(side - 1, NEVER)].astype(np.int64)
        products = scan([np.frombuffer(m, np.int64).reshape(side, side) for m in part["matrix"][:-1]])
        reached = [begin] + [np.maximum((begin[:, None] + m).max(axis=0), NEVER) for m in products]
        return part[[*KEY, "idx", "run"]].assign(entry=[r.tobytes() for r in reached])

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            maps = []
            for t, a, e in zip(b["chunk"], b["ahead"], b["entry"]):
                model, text = model_of(path), t + a
                back = model.forward(text, len(t), np.frombuffer(e, np.int64).tolist())[1]
                maps.append([model.trace(text, back, len(t) + j)[0] if j <= len(a) else 0 for j in range(model.longest)])
            yield b[[*KEY, "idx", "run"]].assign(enters=maps)

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        part, state, out = part.sort_values("idx", ascending=False), 0, []
        for enters in part["enters"]:
            out.append(state)
            state = int(enters[state])
        return part[[*KEY, "idx", "run"]].assign(leaves=out)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for t, a, e, j in zip(b["chunk"], b["ahead"], b["entry"], b["leaves"]):
                model, text = model_of(path), t + a
                back = model.forward(text, len(t), np.frombuffer(e, np.int64).tolist())[1]
                found.append(np.asarray(model.trace(text, back, len(t) + int(j))[1], dtype="<u4").tobytes())
            yield b[[*KEY, "idx"]].assign(ids=found)

    on = [*KEY, "idx", "run"]
    same = lambda a, b: a.join(b.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in b.columns if c not in on]), [
        F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]).drop(*[f"__{c}" for c in on])
    entered = stored(same(soft, soft.mapInPandas(matrices, f"{keys}, matrix binary").groupBy(*KEY, "run").applyInPandas(entries, f"{keys}, entry binary")))
    left = entered.mapInPandas(exits, f"{keys}, enters array<int>").groupBy(*KEY, "run").applyInPandas(compose, f"{keys}, leaves int")
    return same(entered, left).mapInPandas(pieces, "doc_id long, tag long, copy long, idx int, ids binary")


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunk: int | None = None,
                     read_back: bool = False) -> DataFrame:
    """doc_id and ``ids`` (binary, little-endian 32 bits) of every row.

    ``read_back`` adds the ``text`` the ids read back to, in the same workers: a second Python stage would have its own, with a model each.
    """
    schema = "doc_id long, ids binary" + (", text string" if read_back else "")
    size = chunk or CHUNK
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    # one chunk has at most the bytes of its text
    short, long = rows.filter(F.octet_length("text") < size), rows.filter(F.octet_length("text") >= size)

    def told(own: pd.Series, ids: list[bytes]) -> pd.DataFrame:
        out = pd.DataFrame({"doc_id": own.astype("Int64").array, "ids": ids})
        return out.assign(text=read(ids, path)) if read_back else out

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for held in parts(b["text"]):
                yield told(b["doc_id"].iloc[at:at + len(held)], model_of(path).encode([marked_text(t) for t in held]))
                at += len(held)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own, tag, copy, t in zip(b["doc_id"], b["tag"], b["copy"], b["text"]):
                pieces, run = cut_chunks(marked_text(t), model_of(path), size), 0
                for at in range(0, len(pieces), 64):
                    out = []
                    for i, (piece, ahead, soft_in, soft_out) in enumerate(pieces[at:at + 64], at):
                        run += not soft_in
                        out.append((own, tag, copy, i, run, piece, ahead, soft_in, soft_out))
                    yield pd.DataFrame(out, columns=[*KEY, "idx", "run", "chunk", "ahead", "soft_in", "soft_out"]).astype({"doc_id": "Int64"})

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[*KEY, "idx"]].assign(ids=[i for held in parts(b["chunk"]) for i in model_of(path).encode(held)])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own, ids, copies in zip(b["doc_id"].astype("Int64"), b["parts"], b["copies"]):
                row = told(pd.Series([own], dtype="Int64"), [b"".join(ids)])
                for _ in range(copies):
                    yield row

    distinct = long.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copy")).withColumn("tag", F.xxhash64("text"))
    chunks = stored(distinct.select("doc_id", "tag", "copy", "text").repartition(hash_slots(docs.sparkSession)).mapInPandas(
        cut, "doc_id long, tag long, copy long, idx int, run int, chunk string, ahead string, soft_in boolean, soft_out boolean"))
    free = chunks.filter("not soft_in and not soft_out").mapInPandas(giving_back(alone), "doc_id long, tag long, copy long, idx int, ids binary")
    soft = soft_paths(chunks.filter("soft_in or soft_out"), path)
    gathered = (free.unionByName(soft).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", "ids"))).alias("parts"))
             .select("doc_id", F.col("copy").alias("copies"), F.transform("parts", lambda x: x["ids"]).alias("parts")))
    return short.mapInPandas(giving_back(whole), schema).unionByName(gathered.mapInPandas(giving_back(joined), schema))


def read(ids: list[bytes], path: str) -> list[str]:
    return [model_of(path).decode(np.frombuffer(i, "<u4")) for i in ids]


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The encoded rows and the ``text`` their ids read back to."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(doc_id=b["doc_id"].astype("Int64"), text=read(b["ids"], path))

    return encoded.select("doc_id", "ids").mapInPandas(giving_back(apply), "doc_id long, ids binary, text string")

