"""Repeated byte strings over all documents by a distributed difference-cover suffix naming.

Wanted are the positions whose next ``length`` bytes also start earlier. The steps are those of the
difference-cover construction of a suffix array, cut off at ``length`` bytes:

1. Sample (``cover``): every string is represented by one sampled position at a distance that only its content
   decides. The strings of one sample are a run of neighbouring starts; its triple (bytes before the sample, the
   sampled gram, bytes after it), as far as the run's strings reach, is named.
2. Sort the sampled triples: a sample whose triple is named like that of an earlier one is a repeat with all its
   strings, a sample whose gram stands nowhere else has none. Only samples that share their
   gram with other triples stay open.
3. Recurse on the names of the open ones: a run falls into cells of ``CELL`` starts on the sample's own
   grid, which are named and sorted the same way.
4. Merge the remaining suffixes, the single starts of open cells, by (distance to the sample, string), and
   compare neighbours in the order: all but the first of equal prefixes are repeats.

Grams, triples and strings enter as 64-bit hashes, and names compare as pairs of two of them; sorting by hash
serves as well as by bytes, as only equal prefixes matter. The cover replaces residues
modulo a constant because those sample a fixed share of all bytes: one row of 16 bytes for each of
them is many times the input, while this cover keeps one in 33 and is open for a few percent of these.

Names are packed: a task sends one row of arrays to each block of names, a task sorts whole
blocks. Equal names within a task are resolved before they are sent, so a passage that a third of all documents
hold sends one name a task. Grams that many documents share (a list of bounded length) are spread by name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cover import sampled_runs
from .shared import giving_back, hash_slots, numbered, stored, whole_text

#: Bytes of a sampled gram; starts in a cell; samples in a block of names; bytes of text handled at a time.
GRAM, CELL, BLOCK, PART = 36, 8, 1_000_000, 12_000_000
#: A gram is common if at least one in COMMON documents holds it.
COMMON = 250
PLAIN, HOT, DONE = 0, 1, 2
#: Stands for a null id in the order: before every other.
NULL_ID = -2**63
FIELDS = {"docs": np.int64, "tags": np.uint32, "cores": np.uint64, "names": np.uint64, "firsts": np.uint32,
          "spans": np.uint8, "sides": np.uint8, "flags": np.uint8}


@dataclass
class Names:
    """Parallel arrays: document, tag of its text, gram, name, first start, further starts, distance to the sample, flag."""

    docs: np.ndarray
    tags: np.ndarray
    cores: np.ndarray
    names: np.ndarray
    firsts: np.ndarray
    spans: np.ndarray
    sides: np.ndarray
    flags: np.ndarray

    @classmethod
    def of(cls, parts: list[tuple]) -> Names:
        """From tuples of arrays in field order; scalars are repeated."""
        columns: list[list] = [[] for _ in FIELDS]
        for part in parts:
            n = len(part[2])
            for column, value, kind in zip(columns, part, FIELDS.values()):
                column.append(np.full(n, value, dtype=kind) if np.ndim(value) == 0 else np.asarray(value).astype(kind))
        return cls(*[np.concatenate(c) if c else np.array([], dtype=k) for c, k in zip(columns, FIELDS.values())])

    def take(self, which: np.ndarray) -> Names:
        return Names(*[getattr(self, f)[which] for f in FIELDS])

    def __len__(self) -> int:
        return len(self.docs)

    def ordered(self) -> tuple[Names, np.ndarray, np.ndarray]:
        """By gram, name, then place, without repeats of one place; where the gram is new, where the name is."""
        own = self.take(np.lexsort((self.firsts, self.tags, self.docs, self.names, self.cores)))
        change = lambda x: np.r_[True, x[1:] != x[:-1]] if len(x) else np.array([], dtype=bool)
        core = change(own.cores)
        name = core | change(own.names)
        place = name | change(own.docs) | change(own.tags) | change(own.firsts)
        return (own, core, name) if place.all() else (own.take(place), core[place], name[place])


def group_of(doc: int, tag: int, groups: int) -> int:
    """The group Spark's ``pmod(xxhash64(doc, tag), groups)`` gives: by id and text, so that rows that share an id, or have none, are spread."""
    raw = 42
    for value in (doc, tag):
        raw = xxhash.xxh64_intdigest(int(value).to_bytes(8, "little", signed=True), seed=raw)
    return (raw - 2**64 if raw >= 2**63 else raw) % groups


def pack(names: Names, blocks: int) -> pd.DataFrame:
    """Resolve what repeats within the task, and cut the rest into one row for each block of names."""
    done, names = names.take(names.flags == DONE), names.take(names.flags != DONE)
    own, _, new = names.ordered()
    own.flags = np.where(new, own.flags, DONE).astype(np.uint8)
    own = Names(*[np.concatenate((getattr(own, f), getattr(done, f))) for f in FIELDS])
    spread = np.select([own.flags == HOT, own.flags == DONE], [own.names, own.docs.view(np.uint64) + own.tags], own.cores)
    block = ((spread ^ (spread >> np.uint64(33))) % np.uint64(blocks)).astype(np.int32)
    own, block = own.take(order := np.lexsort((own.firsts, own.tags, own.docs, block))), block[order]
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(own) else np.array([], dtype=int)
    rows = []
    for a, b in zip(cuts, np.r_[cuts[1:], len(own)]):
        docs, tags = own.docs[a:b], own.tags[a:b]
        starts = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])])
        rows.append((int(block[a]), docs[starts].tobytes(), tags[starts].tobytes(), np.diff(np.r_[starts, b - a]).astype(np.uint32).tobytes(),
                     *[getattr(own, f)[a:b].tobytes() for f in list(FIELDS)[2:]]))
    return pd.DataFrame(rows, columns=["block", "docs", "tags", "counts", *list(FIELDS)[2:]])


PACKED = "block int, docs binary, tags binary, counts binary, " + ", ".join(f"{f} binary" for f in list(FIELDS)[2:])
FOUND = "grp int, open boolean, " + ", ".join(f"{f} binary" for f in FIELDS if f not in ("cores", "names"))


def unpack(part: pd.DataFrame) -> Names:
    read = lambda f, kind: np.frombuffer(b"".join(part[f]), dtype=kind)
    counts = read("counts", np.uint32)
    return Names(np.repeat(read("docs", np.int64), counts), np.repeat(read("tags", np.uint32), counts),
                 *[read(f, k) for f, k in list(FIELDS.items())[2:]])


def sort_names(packed: DataFrame, groups: int) -> DataFrame:
    """Sort each block; answer, for each group of documents, which runs are repeats and which stay open."""
    def apply(part: pd.DataFrame) -> pd.DataFrame:
        names = unpack(part)
        done, names = names.take(names.flags == DONE), names.take(names.flags != DONE)
        own, core, new = names.ordered()
        del names
        gram = np.cumsum(core) - 1
        several = np.bincount(gram, weights=new)[gram] > 1 if len(own) else np.array([], dtype=bool)
        rows = []
        for is_open, found in ((False, [own.take(~new), done]), (True, [own.take(new & (several | (own.flags == HOT)))])):
            found = Names(*[np.concatenate([getattr(x, f) for x in found]) for f in FIELDS])
            found = found.take(np.lexsort((found.tags, found.docs)))
            new_text = np.r_[True, (found.docs[1:] != found.docs[:-1]) | (found.tags[1:] != found.tags[:-1])] if len(found) else np.array([], dtype=bool)
            groups_of = [group_of(d, t, groups) for d, t in zip(found.docs[new_text].tolist(), found.tags[new_text].tolist())]
            group = np.array(groups_of, dtype=np.int32)[np.cumsum(new_text) - 1] if len(found) else np.array([], dtype=np.int32)
            found, group = found.take(order := np.argsort(group, kind="stable")), group[order]
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(group)] if len(group) else []):
                rows.append((int(group[a]), is_open, *[getattr(found, f)[a:b].tobytes() for f in FIELDS if f not in ("cores", "names")]))
        return pd.DataFrame(rows, columns=["grp", "open", *[f for f in FIELDS if f not in ("cores", "names")]])

    return packed.groupBy("block").applyInPandas(giving_back(apply), FOUND)


def found_by_document(part: pd.DataFrame | pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Rows (first, further starts, distance to the sample, flag) of each document, in order."""
    if not len(part):
        return {}
    read = lambda f: np.frombuffer(b"".join(part[f] if isinstance(part, pd.DataFrame) else part[f].to_pylist()), dtype=FIELDS[f])
    docs, tags = read("docs"), read("tags")
    rows = np.column_stack([read(f).astype(np.int64) for f in ("firsts", "spans", "sides", "flags")])
    order = np.lexsort((rows[:, 0], tags, docs))
    docs, tags, rows = docs[order], tags[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])])
    return {(int(docs[a]), int(tags[a])): rows[a:b] for a, b in zip(cuts, np.r_[cuts[1:], len(docs)])}


def tag_of(raw: bytes) -> int:
    """Tells texts apart that share an id, and orders them: the lower half of Spark's ``xxhash64(text)``."""
    return xxhash.xxh64_intdigest(raw, seed=42) & 0xFFFFFFFF


def group_column(doc: Column, tag: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(doc, tag), F.lit(groups)).cast("int")


def tag_column(text: str) -> Column:
    return F.xxhash64(whole_text(text)).bitwiseAND(F.lit(0xFFFFFFFF))


def parts(batch: pd.DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for doc, text in zip(batch["doc"], batch["text"]):
        raw = text.encode("utf-8", "replace")
        held.append((int(doc), raw))
        size += len(raw)
        if size > PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def common_grams(texts: DataFrame, length: int, documents: int) -> np.ndarray:
    """Sampled grams of at least one in COMMON documents: at most 2 * COMMON times the mean samples of a document."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for held in parts(batch):
                grams = [np.unique(sampled_runs(np.frombuffer(raw, np.uint8), length, GRAM)[3]) for raw in {raw for _, raw in held}]
                if grams:
                    gram, count = np.unique(np.concatenate(grams), return_counts=True)
                    often = count >= max(2, len(held) // (2 * COMMON))
                    yield pd.DataFrame({"gram": gram[often].view(np.int64), "held": count[often]})

    counted = texts.mapInPandas(giving_back(apply), "gram long, held long").groupBy("gram").agg(F.sum("held").alias("held"))
    rows = counted.filter(F.col("held") * (2 * COMMON) >= documents).select("gram").collect()
    return np.sort(np.array([r.gram for r in rows], dtype=np.int64).view(np.uint64))


def sampled_triples(texts: DataFrame, length: int, common: np.ndarray, blocks: int) -> DataFrame:
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for held in parts(batch):
                rows = []
                for doc, raw in held:
                    first, last, sample, gram = sampled_runs(np.frombuffer(raw, np.uint8), length, GRAM)
                    if len(first):
                        names = [xxhash.xxh3_64_intdigest(raw[a:b + length]) for a, b in zip(first.tolist(), last.tolist())]
                        at = np.minimum(np.searchsorted(common, gram), max(len(common) - 1, 0))
                        hot = np.where(common[at] == gram, HOT, PLAIN) if len(common) else PLAIN
                        rows.append((doc, tag_of(raw), gram, np.array(names, dtype=np.uint64), first, last - first, sample - first, hot))
                yield pack(Names.of(rows), blocks)

    return texts.mapInPandas(giving_back(apply), PACKED)


def open_runs(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The bytes of open runs, read from their documents once."""
    def apply(docs: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        wanted, rows = found_by_document(part), []
        if wanted:
            for doc, text in zip(docs["doc"], docs["text"]):
                raw = text.encode("utf-8", "replace")
                key = (int(doc), tag_of(raw))
                for first, span, side, flag in wanted.pop(key, np.empty((0, 4), dtype=np.int64)).tolist():
                    rows.append((*key, first, span, side, flag, raw[first:first + span + length]))
        return pd.DataFrame(rows, columns=["doc", "tag", "first", "span", "side", "flag", "bytes"])

    opened = found.filter("open")
    return texts.groupBy("grp").cogroup(opened.groupBy("grp")).applyInPandas(
        giving_back(apply), "doc long, tag long, first long, span int, side int, flag int, bytes binary")


def cells(runs: DataFrame, length: int, blocks: int) -> DataFrame:
    """Names of the cells of open runs; a cell's gram is what all its strings have in common."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = xxhash.xxh3_64_intdigest
        for batch in batches:
            docs, tags, firsts, spans, sides, flags, cores, names = ([] for _ in range(8))
            for doc, tag, first, span, side, flag, raw in batch.itertuples(index=False):
                for c in range((side - span) // CELL, side // CELL + 1):
                    low, high = max(side - CELL * c - CELL + 1, 0), min(side - CELL * c, span)
                    if low <= high:
                        docs.append(doc)
                        tags.append(tag)
                        firsts.append(first + low)
                        spans.append(high - low)
                        sides.append(side - low)
                        flags.append(flag)
                        cores.append(name(raw[side - CELL * c:side - CELL * c + length - CELL + 1], seed=c & 0xFF))
                        names.append(name(raw[low:high + length]))
            whole = lambda x: np.array(x, dtype=np.uint64)
            yield pack(Names.of([(np.array(docs, dtype=np.int64), np.array(tags), whole(cores), whole(names), np.array(firsts), np.array(spans), np.array(sides), np.array(flags))]), blocks)

    return runs.mapInPandas(giving_back(apply), PACKED)


def single_starts(runs: DataFrame, found: DataFrame, length: int, blocks: int, groups: int) -> DataFrame:
    """Names of the single starts of open cells."""
    def apply(own: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        wanted, rows = found_by_document(part), []
        if wanted:
            at = {(doc, tag, first + side): (first, raw) for doc, tag, first, side, raw in zip(
                own["doc"].tolist(), own["tag"].tolist(), own["first"].tolist(), own["side"].tolist(), own["bytes"])}
            for (doc, tag), held in wanted.items():
                for first, span, side, _ in held.tolist():
                    begin, raw = at[doc, tag, first + side]
                    strings = [raw[s:s + length] for s in range(first - begin, first - begin + span + 1)]
                    rows.append((doc, tag, np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in strings], dtype=np.uint64),
                                 np.array([xxhash.xxh3_64_intdigest(x) for x in strings], dtype=np.uint64),
                                 np.arange(first, first + span + 1), 0, 0, PLAIN))
        return pack(Names.of(rows), blocks)

    grouped = runs.withColumn("grp", group_column(F.col("doc"), F.col("tag"), groups))
    return grouped.groupBy("grp").cogroup(found.filter("open").groupBy("grp")).applyInPandas(giving_back(apply), PACKED)


def merged(rows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges of a document."""
    if not len(rows):
        return []
    begin, end = rows[:, 0], np.maximum.accumulate(rows[:, 0] + rows[:, 1] + length)
    new = np.r_[True, begin[1:] > end[:-1]]
    starts = np.flatnonzero(new)
    return list(zip(begin[starts].tolist(), end[np.r_[starts[1:], len(end)] - 1].tolist()))


def without_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of the documents, ``text`` without its repeated bytes, and n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document of smaller id, or
    earlier in its own. Null ids stand first; rows that share an id but not the text stand in order of a hash of the
    text; rows repeated whole are one document, each reported. Null text is empty text and stays null unless
    bytes go, which cannot be. A character that loses some of its bytes leaves the text; the digest is of the
    bytes. An empty table gives no rows. Columns named like an added one are replaced, others may have any name.
    """
    spark, added = docs.sparkSession, {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    kept = [c for c in docs.columns if c not in added]
    docs, doc_id, text = numbered(docs.select(*kept)), f"c{kept.index(doc_id)}", f"c{kept.index(text)}"
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    plain = docs.select(key.alias("doc"), whole_text(text).alias("text"))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(whole_text(text))).alias("bytes")).first()
    blocks = max(hash_slots(spark), int((size["bytes"] or 0) / 33 / BLOCK) + 1)
    group = group_column(F.col("doc"), tag_column("text"), blocks)
    common = common_grams(plain, length, size["n"])
    first = stored(sort_names(sampled_triples(plain, length, common, blocks), blocks))
    runs = stored(open_runs(plain.withColumn("grp", group), first, length))
    second = stored(sort_names(cells(runs, length, blocks), blocks))
    third = sort_names(single_starts(runs, second, length, blocks, blocks), blocks)
    repeats = first.unionByName(second).unionByName(third).filter("not open")

    at = docs.columns.index(text)
    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in docs.columns)

    def apply(own: pa.Table, part: pa.Table) -> pa.Table:
        wanted, texts, told = found_by_document(part), [], []
        for doc, value in zip(own.column("__doc").to_pylist(), own.column(at).to_pylist()):
            raw = (value or "").encode("utf-8", "replace")
            spans = merged(wanted.get((doc, tag_of(raw)), np.empty((0, 4), dtype=np.int64)), length) if wanted else []
            rest = raw
            if spans:
                cuts = [0, *[x for s in spans for x in s], len(raw)]
                rest = b"".join(raw[cuts[i]:cuts[i + 1]] for i in range(0, len(cuts), 2))
                value = rest.decode("utf-8", "ignore")
            texts.append(value)
            told.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()))
        columns = [own.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(docs_columns))]
        columns += [pa.array([t[i] for t in told], kind) for i, kind in enumerate(added.values())]
        return pa.Table.from_arrays(columns, names=[*docs_columns, *added])

    docs_columns = docs.columns
    whole = docs.select(*docs_columns, key.alias("__doc"), group_column(key, tag_column(text), blocks).alias("grp"))
    return whole.groupBy("grp").cogroup(repeats.groupBy("grp")).applyInArrow(
        giving_back(apply), f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").toDF(*kept, *added)
