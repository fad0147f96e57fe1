"""Jaccard self-join of documents on word n-grams as a blocked sparse matrix product.

Rows of the incidence matrix are the distinct n-gram sets (copies are one row), columns are n-grams. The
product of the matrix with its transpose counts the n-grams two rows share; two rows of sizes m and n can
reach the similarity s = p/q only if they share at least ceil(s * max(m, n)), which gives three bounds:

* columns are ordered from the rarest to the most common, and of a row only the first
  n - ceil(s * n) + 1 columns can be the first that it shares with a partner;
* columns of a single row count against that number and are then gone, so a text without
  near copies leaves the product at once;
* sizes whose ratio is below s are never multiplied, nor are rows of which one has so many columns of
  its own that what is left cannot reach the overlap, nor rows whose counts in parts of the columns cannot.

Column frequencies are counted in blocks: tasks cut their rows' n-grams into column blocks, one packed
row for each, one task counts a whole column block and answers in packed row blocks. Columns that a large
share of the documents hold are found beforehand (a list of bounded length), travel
spread over all blocks and rank last, so no block is longer than the others.

Multiplied blocks would repeat most pairs of a large group of near copies. Only connected components
are wanted, so each surviving column first meets one of its rows (a star), links found merge rows
into components, and then only rows of different components are multiplied. Every pair that
can be linked is either compared exactly or already connected: no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import giving_back, hash_slots, stored, whole_text
from .shingles import shingle_set

#: A column is common if at least one in COMMON documents holds it; n-grams of a column block; characters handled at a time.
COMMON, BLOCK, PART = 250, 1_000_000, 6_000_000
#: Rounds in which each column meets one row before all that is left is multiplied.
STARS = 2
#: Parts of the columns in which rows are counted to bound what two of them share.
PARTS = 128


def least_overlap(n: np.ndarray, p: int, q: int) -> np.ndarray:
    """Fewest n-grams a partner must share with a row of n: ceil(p / q * n)."""
    return -(-p * n // q)


def row_sets(batch: pd.DataFrame, width: int) -> Iterator[tuple[list, list[np.ndarray], list[bytes]]]:
    """Ids, sets and digests of a batch, in parts of about PART characters."""
    ids, sets, digests, held = [], [], [], 0
    for own, text in zip(batch["doc_id"], batch["text"]):
        found = shingle_set(text, width)
        ids.append(own)
        sets.append(found)
        digests.append(xxhash.xxh3_128_digest(found.tobytes()))
        held += len(text)
        if held > PART:
            yield ids, sets, digests
            ids, sets, digests, held = [], [], [], 0
    if ids:
        yield ids, sets, digests


def distinct_sets(sets: list[np.ndarray], digests: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    own = {d: s for d, s in zip(digests, sets) if len(s)}
    return list(own), list(own.values())


def low_half(cls: bytes) -> int:
    return int.from_bytes(cls[8:], "little", signed=True)


def describe(docs: DataFrame, width: int) -> DataFrame:
    """Of each document: doc_id, n, cls (digest of its set); besides, counts of columns that are
    frequent within a batch, in rows whose ``n`` is null."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, sets, digests in row_sets(batch, width):
                yield pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "n": pd.array([len(s) for s in sets], dtype="Int64"),
                                    "cls": digests, "lo": [low_half(d) for d in digests], "h": pd.array([None] * len(ids), dtype="Int64"), "held": 0})
                _, rows = distinct_sets(sets, digests)
                if rows:
                    h, count = np.unique(np.concatenate(rows), return_counts=True)
                    often = count >= max(2, len(rows) // (2 * COMMON))
                    h, count = h[often].view(np.int64), count[often]
                    yield pd.DataFrame({"doc_id": pd.array([None] * len(h), dtype="Int64"), "n": pd.array([None] * len(h), dtype="Int64"),
                                        "cls": [None] * len(h), "lo": 0, "h": pd.array(h, dtype="Int64"), "held": count})

    return docs.mapInPandas(giving_back(apply), "doc_id long, n long, cls binary, lo long, h long, held long")


def column_blocks(docs: DataFrame, width: int, common: np.ndarray, blocks: int, groups: int) -> DataFrame:
    """Packed blocks of the incidence matrix: block; of its rows the group, key and number of n-grams; the n-grams."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, sets, digests in row_sets(batch, width):
                names, rows = distinct_sets(sets, digests)
                if not rows:
                    continue
                h = np.concatenate(rows)
                row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
                keys = np.array([int.from_bytes(c[:8], "little") for c in names], dtype=np.uint64)
                group = np.array([low_half(c) % groups for c in names], dtype=np.int32)
                at = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
                hot = common[at] == h if len(common) else np.zeros(len(h), dtype=bool)
                block = np.where(hot, (h >> np.uint64(20)) + keys[row], h >> np.uint64(20)) % np.uint64(blocks)
                order = np.argsort(block.astype(np.int32), kind="stable")
                h, row, block, hot = h[order], row[order], block[order], hot[order]
                cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                out = []
                for a, b in zip(cuts, np.r_[cuts[1:], len(h)]):
                    starts = np.flatnonzero(np.r_[True, row[a + 1:b] != row[a:b - 1]])
                    own = row[a:b][starts]
                    out.append((int(block[a]), group[own].tobytes(), keys[own].tobytes(),
                                np.diff(np.r_[starts, b - a]).astype(np.int32).tobytes(), h[a:b].tobytes(), np.packbits(hot[a:b]).tobytes()))
                yield pd.DataFrame(out, columns=["block", "groups", "keys", "counts", "grams", "hot"])

    return docs.mapInPandas(giving_back(apply), "block int, groups binary, keys binary, counts binary, grams binary, hot binary")


def joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind)


def count_columns(blocks: DataFrame) -> DataFrame:
    """Frequencies of a column block, answered for each group of rows; columns of a single row are left out."""
    def apply(part: pd.DataFrame) -> pd.DataFrame:
        counts = joined(part["counts"], np.int32)
        group, key = np.repeat(joined(part["groups"], np.int32), counts), np.repeat(joined(part["keys"], np.uint64), counts)
        h = joined(part["grams"], np.uint64)
        hot = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(g) // 8) for b, g in zip(part["hot"], part["grams"])]).astype(bool)
        order = np.lexsort((key, h))
        group, key, h, hot = group[order], key[order], h[order], hot[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (key[1:] != key[:-1])] if len(h) else hot  # copies of a row come from several tasks
        group, key, h, hot = group[once], key[once], h[once], hot[once]
        column = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1 if len(h) else np.array([], dtype=int)
        rank = np.where(hot, 2**31 - 1, np.bincount(column)[column] if len(h) else 0).astype(np.int32)
        keep = rank > 1
        group, key, h, rank = group[keep], key[keep], h[keep], rank[keep]
        order = np.argsort(group, kind="stable")
        group, key, h, rank = group[order], key[order], h[order], rank[order]
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
        ends = np.r_[cuts[1:], len(group)] if len(group) else []
        return pd.DataFrame([(int(group[a]), key[a:b].tobytes(), h[a:b].tobytes(), rank[a:b].tobytes()) for a, b in zip(cuts, ends)],
                            columns=["grp", "keys", "grams", "ranks"])

    return blocks.groupBy("block").applyInPandas(giving_back(apply), "grp int, keys binary, grams binary, ranks binary")


def leading_columns(rows: DataFrame, counted: DataFrame, p: int, q: int) -> DataFrame:
    """(h, cls, n, s, parts): of each row the shared columns among its first n - ceil(s * n) + 1, rarest first; s counts all its
    shared columns. One more row for each row found, with null h, has ``parts``: its shared columns in each part of all columns."""
    def apply(own: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"h": pd.array([], dtype="Int64"), "cls": np.array([], object), "n": np.array([], np.int64), "s": np.array([], np.int64), "parts": np.array([], object)})
        if own.empty or part.empty:
            return none
        keys = np.array([int.from_bytes(c[:8], "little") for c in own["cls"]], dtype=np.uint64)
        by = np.argsort(keys, kind="stable")
        keys, cls, n = keys[by], own["cls"].to_numpy()[by], own["n"].to_numpy(np.int64)[by]
        key, h, rank = joined(part["keys"], np.uint64), joined(part["grams"], np.uint64), joined(part["ranks"], np.int32)
        row = np.searchsorted(keys, key)
        order = np.lexsort((h, rank, row))
        row, h = row[order], h[order]
        once = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]  # a row may be listed by several tasks
        row, h = row[once], h[once]
        shared = np.bincount(row, minlength=len(keys))
        first = np.r_[0, np.cumsum(shared)[:-1]]
        room = n - least_overlap(n, p, q) + 1 - (n - shared)
        keep = np.arange(len(row)) - first[row] < room[row]
        found = np.unique(row[keep])
        parts = np.bincount(row * PARTS + (h % np.uint64(PARTS)).astype(np.int64), minlength=len(keys) * PARTS).reshape(-1, PARTS)
        lead = pd.DataFrame({"h": pd.array(h[keep].view(np.int64), dtype="Int64"), "cls": cls[row[keep]], "n": n[row[keep]], "s": shared[row[keep]], "parts": None})
        told = pd.DataFrame({"h": pd.array([None] * len(found), dtype="Int64"), "cls": cls[found], "n": n[found], "s": shared[found], "parts": list(parts[found])})
        return pd.concat([lead, told]) if len(found) else none

    return rows.groupBy("grp").cogroup(counted.groupBy("grp")).applyInPandas(giving_back(apply), "h long, cls binary, n long, s long, parts array<int>")


def compared(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, exactly; only sets of a pair are moved."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(q * shared >= p * (len(x) + len(y) - shared))
            yield batch.loc[keep, ["a", "b"]]

    def side(name: str) -> DataFrame:
        used = pairs.select(F.col(name).alias("cls")).distinct()
        return sets.join(used, "cls", "left_semi").select(F.col("cls").alias(name), F.col("grams").alias(f"set_{name}"))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInPandas(giving_back(apply), "a binary, b binary")


def fetch_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, grams) of the wanted classes, computed again from one document of each."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, sets, digests in row_sets(batch, width):
                yield pd.DataFrame({"found": digests, "grams": [s.tobytes() for s in sets], "cls": batch["cls"].iloc[:len(sets)].to_list()})
                batch = batch.iloc[len(sets):]

    texts = docs.join(wanted.select(F.col("doc_id").alias("__id"), "cls"), F.col("doc_id").eqNullSafe(F.col("__id"))).select("doc_id", "text", "cls")
    return (texts.mapInPandas(giving_back(apply), "found binary, grams binary, cls binary").filter("found = cls")
            .select("cls", "grams").dropDuplicates(["cls"]))


def round_pairs(members: DataFrame, parts: DataFrame, labels: DataFrame | None, star: int | None, p: int, q: int) -> DataFrame:
    """Distinct pairs (a, b) of rows that share a column, lie in different components and may reach the similarity.

    ``star``: each column meets one row only: first the one with the fewest columns of its own, which is nearest to the text
    that near copies were made from, then another in each round; None: all rows of the column.
    """
    def fits(x: dict[str, Column], y: dict[str, Column]) -> Column:
        """Sizes, and what both share with any row at all, allow for an overlap of p / (p + q) of their sizes' sum."""
        sizes = F.lit(q) * F.least(x["n"], y["n"]) >= F.lit(p) * F.greatest(x["n"], y["n"])
        return sizes & (F.lit(p + q) * F.least(x["s"], y["s"]) >= F.lit(p) * (x["n"] + y["n"]))

    def named(df: DataFrame, mark: str) -> DataFrame:
        return df.select("h", *[F.col(c).alias(f"{c}_{mark}") for c in ("cls", "n", "s", "comp")])

    known = members.withColumn("comp", F.col("cls"))
    if labels is not None:
        known = (members.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
                 .withColumn("comp", F.coalesce("comp", "cls")))
    order = F.xxhash64("h", "cls", F.lit(star)) if star else F.col("n") - F.col("s")
    split = known.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"),
                                   F.min(F.struct(order.alias("k"), "cls")).alias("pivot")).filter("x <> y")
    bound = F.lit(True)
    if star is None:
        # Two rows share at most the smaller count in each part of the columns.
        left = known.join(split.select("h"), "h").join(parts, "cls")
        one = left.select("h", *[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "s", "comp", "parts")])
        other = left.select("h", *[F.col(c).alias(f"{c}_b") for c in ("cls", "n", "s", "comp", "parts")])
        most = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
        bound = F.lit(p + q) * most >= F.lit(p) * (F.col("n_a") + F.col("n_b"))
    else:
        one = named(known.join(split.select("h", F.col("pivot.cls").alias("cls")), ["h", "cls"]), "a")
        other = named(known, "b")
    side = lambda mark: {c: F.col(f"{c}_{mark}") for c in ("n", "s")}
    apart = (F.col("cls_a") < F.col("cls_b")) if star is None else F.lit(True)
    met = one.join(other, "h").filter(apart & (F.col("comp_a") != F.col("comp_b")) & fits(side("a"), side("b")) & bound)
    return met.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()


def linked_classes(docs: DataFrame, rows: DataFrame, common: np.ndarray, total: int, width: int, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """Labels (node, comp) of the classes that are linked to another, and the links found between classes."""
    spark = docs.sparkSession
    blocks = max(hash_slots(spark), -(-total // BLOCK))
    counted = count_columns(column_blocks(docs, width, common, blocks, blocks))
    grouped = rows.withColumn("grp", F.pmod("lo", F.lit(blocks)).cast("int")).select("grp", "cls", "n")
    lead = stored(leading_columns(grouped, counted, p, q))
    parts = lead.filter("h is null").select("cls", "parts")
    lead = lead.filter("h is not null").select("h", "cls", "n", "s")
    several = lead.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    members = stored(lead.join(several, "h"))
    wanted = members.select("cls").distinct().join(rows.select("cls", "doc_id"), "cls")
    sets = stored(fetch_sets(docs, wanted, width))
    links, labels = None, None
    for star in [*range(STARS), None]:
        pairs = stored(round_pairs(members, parts, labels, star, p, q))
        if links is not None and pairs.isEmpty():
            continue
        found = stored(compared(pairs, sets, p, q))
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
    return labels, links


def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents whose sets' Jaccard similarity is p/q or more are linked.

    Null text is empty; a text without words has an empty set and is linked with nothing. Rows that repeat a document
    are each reported and in one component. ``component_id`` is the smallest id of the component, null where no
    row of it has an id. An empty table gives no rows.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    told = stored(describe(given, width))
    own = told.filter("n is not null").select("doc_id", "n", "cls", "lo")
    rows = stored(own.filter("n > 0").groupBy("cls", "lo", "n").agg(F.min("doc_id").alias("doc_id")))
    size = own.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams")).first()
    often = (told.filter("n is null").groupBy("h").agg(F.sum("held").alias("held"))
             .filter(F.col("held") * (2 * COMMON) >= size["docs"]).select("h"))
    # at most 2 * COMMON times the mean set size: a column on it is held by one document in 2 * COMMON
    common = np.sort(np.array([r.h for r in often.collect()], dtype=np.int64).view(np.uint64))
    labels, _ = linked_classes(given, rows, common, int(size["grams"] or 0), width, p, q)
    by_class = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "doc_id", F.coalesce("comp", "cls").alias("comp"))
    smallest = by_class.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    classes = by_class.select("cls", "comp").join(smallest, "comp").select("cls", "component_id")
    whole = own.filter("n > 0").join(classes, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(own.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
