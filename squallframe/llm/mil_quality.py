"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (shape of its text, never its
words' identity, then one hidden layer), a gated attention layer weighs the passages, and the
weighted passage representation gives the score:

    h = tanh(E x + e),  a = softmax over passages of w . (tanh(V h) * sigmoid(U h)),  p = sigmoid(c . sum(a h) + d)

Only document labels are known; attention and score are learnt together from them.

The model is fitted on at most ``per_class`` labelled documents of either label, those with the smallest hashed
ids, weighted back to the labels' shares in all learnable rows; every document is scored, whole.

Defined results: null text is empty text, which is one empty passage; repeated labels of a document count as
the lowest; rows that repeat are each scored; null ids are kept and never learnt from; where
nothing can be learnt every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import giving_back, whole_text

PASSAGE = 64
LOWER, UPPER, DIGIT, BLANK, LINE, STOP, SYMBOL = range(7)
#: Per passage: share of each class, words in it, mean word length, share of words that are new in it, share of
#: words equal to the one before, share of words ending in a symbol, of words all in upper case.
WIDTH = 13
_CLASSES: list[np.ndarray] = []
_BYTES = np.random.default_rng(20240501).integers(1, 2**63, 4096, dtype=np.uint64)


def point_classes() -> np.ndarray:
    """Class of every code point; made once in each process."""
    if not _CLASSES:
        def of(c: str) -> int:
            if c.isalpha():
                return UPPER if c.isupper() else LOWER
            return DIGIT if c.isdigit() else LINE if c == "\n" else BLANK if c.isspace() else STOP if c in ".,;:'\"-?!()" else SYMBOL
        _CLASSES.append(np.fromiter((of(chr(i)) for i in range(0x110000)), dtype=np.int8, count=0x110000))
    return _CLASSES[0]


def passage_features(text: str) -> np.ndarray:
    """One row of features for each passage of the text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    kinds = point_classes()[points].astype(np.int64)
    gap = (kinds == BLANK) | (kinds == LINE)
    inside = ~gap
    starts = np.flatnonzero(inside & np.r_[True, gap[:-1]]) if len(points) else np.array([], dtype=np.int64)
    if not len(starts):
        return np.zeros((1, WIDTH), dtype=np.float32)
    ends = np.flatnonzero(inside & np.r_[gap[1:], True]) + 1
    n = -(-len(starts) // PASSAGE)
    bounds = np.r_[0, starts[PASSAGE::PASSAGE], len(points)]
    passage = np.repeat(np.arange(n), np.diff(bounds))
    shares = np.bincount(passage * 7 + kinds, minlength=7 * n).reshape(n, 7) / np.diff(bounds)[:, None]
    lengths = ends - starts
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[points & 4095])]
    words = (sums[ends] - sums[starts]) * np.uint64(0x9E3779B97F4A7C15) ^ lengths.astype(np.uint64)
    of = np.arange(len(starts)) // PASSAGE
    per = np.bincount(of, minlength=n).astype(float)
    order = np.lexsort((words, of))
    new = np.r_[True, (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])]
    same = np.r_[False, (words[1:] == words[:-1]) & (of[1:] == of[:-1])]
    uppers = np.r_[0, np.cumsum(kinds == UPPER)]
    lowers = np.r_[0, np.cumsum(kinds == LOWER)]
    shout = (uppers[ends] - uppers[starts] > 1) & (lowers[ends] == lowers[starts])
    mean = lambda x: np.bincount(of, weights=x, minlength=n) / per
    return np.column_stack((shares, per / PASSAGE, mean(lengths) / 10, mean(np.bincount(order[new], minlength=len(words))), mean(same),
                            mean(kinds[ends - 1] == SYMBOL), mean(shout))).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Gated attention over encoded passages; weights are plain arrays, so tasks get a copy of some kilobytes."""

    hidden: int = 16
    gate: int = 8
    seed: int = 7
    center: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    spread: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        shapes = {"E": (WIDTH, self.hidden), "e": (self.hidden,), "V": (self.hidden, self.gate), "U": (self.hidden, self.gate),
                  "w": (self.gate,), "c": (self.hidden,), "d": (1,)}
        self.weights = self.weights or {k: rng.normal(0, 0.3, s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Scores of bags; ``starts`` are the rows of x at which bags begin."""
        p = self.weights
        bag = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        h = np.tanh((x - self.center) / self.spread @ p["E"] + p["e"])
        tv, su = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        logit = (tv * su) @ p["w"]
        a = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return sigmoid(z @ p["c"] + p["d"]), {"bag": bag, "h": h, "tv": tv, "su": su, "a": a, "z": z}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        score, s = self.forward(x, starts)
        bag, h, tv, su, a, z = (s[k] for k in ("bag", "h", "tv", "su", "a", "z"))
        out = (score - y) * weight / weight.sum()
        dz = out[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        dl = a * (da - np.add.reduceat(a * da, starts)[bag])
        dtv, dsu = dl[:, None] * p["w"] * su * (1 - tv ** 2), dl[:, None] * p["w"] * tv * su * (1 - su)
        dh = a[:, None] * dz[bag] + dtv @ p["V"].T + dsu @ p["U"].T
        dpre = dh * (1 - h ** 2)
        xs = (x - self.center) / self.spread
        return {"E": xs.T @ dpre, "e": dpre.sum(axis=0), "V": h.T @ dtv, "U": h.T @ dsu, "w": (tv * su).T @ dl, "c": z.T @ out, "d": out.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01) -> AttentionModel:
        """Adam over shuffled batches of bags, seeded."""
        rows = np.concatenate(bags).astype(float)
        self.center, self.spread = rows.mean(axis=0), rows.std(axis=0) + 1e-3
        rng, step = np.random.default_rng(self.seed), 0
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(w) for k, w in self.weights.items()}
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at:at + batch]
                starts = np.cumsum([0, *[len(bags[i]) for i in own[:-1]]])
                grad = self.gradient(np.concatenate([bags[i] for i in own]).astype(float), starts, y[own], weight[own])
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = 1500,
          doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> AttentionModel | None:
    """Fit on a bounded sample; None where no label can be learnt from."""
    known = (labels.filter(learnable & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).alias("y")))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return None
    of = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
    chosen = of(0).unionByName(of(1))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "x": [passage_features(t).tobytes() for t in batch["text"]]})

    rows = (docs.select(F.col(doc_id).alias("id"), whole_text(text).alias("text"))
            .join(F.broadcast(chosen), F.col("id") == F.col("__id"))
            .groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("digest"), "text")).alias("one"))  # at most 2 * per_class rows
            .select("id", "y", "one.text").mapInPandas(encode, "id long, y int, x binary").collect())
    rows.sort(key=lambda r: (r.id, bytes(r.x)))
    if not rows:
        return None
    y = np.array([r.y for r in rows], dtype=float)
    share = {k: n / sum(totals.values()) / max(1, (y == k).sum()) for k, n in totals.items()}
    weight = np.array([share[int(k)] for k in y]) * len(y)
    return AttentionModel().fit([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows], y, weight)


def score(docs: DataFrame, model: AttentionModel | None, doc_id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """All columns of the documents and ``out``, the probability of label 1."""
    names = [c for c in docs.columns if c != out]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{out}` double"
    at = names.index(text)

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            values = np.full(len(texts), 0.5)
            if model is not None and texts:
                bags = [passage_features(t) for t in texts]
                starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
                values = model.forward(np.concatenate(bags).astype(float), starts)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*names, out])

    return docs.select(*names).mapInArrow(giving_back(apply), schema)
