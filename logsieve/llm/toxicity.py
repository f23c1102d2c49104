"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are its lower-cased words and their prefixes of four to six letters, each with
its count, and whether a prefix occurs twice, four or eight times. The model is P(grade <= k) = logistic(threshold_k - w . x): one weight vector for
all grades, and ordered thresholds (each is the one before plus an exponential). The output is the expected severity,
the sum over k of P(grade > k), with the probability of any toxicity and the likeliest grade.

A feature is taken up if toxic rows hold it at ``FACTOR`` times the rate of the others, and so much more often that by chance
(Fisher's exact test) fewer than ``BY_CHANCE`` of all features tested would. So the bound falls with the rows at hand: five of eleven toxic
rows are enough in a small table, nine of thousands in a large one.

The labels say only toxic or not. Grade 0 is not toxic; toxic rows get grades 1 to 3 by how much evidence they
hold: occurrences of the features, cut at the thirds of the toxic
training rows that hold any.

Fitting reads at most ``max_rows`` labelled rows, a quarter of them toxic, first in hash order; of the features, only those taken up
come to the driver, ``max_features`` at most, the surest first. Scoring is one narrow
pass over every whole text.

Defined results: null and empty texts have no features and get the score of no evidence; repeated rows get equal scores;
null ids are scored; without labels of both classes every severity is 0; an empty table gives an empty result;
other columns pass through, and those named like an added one, in any case, are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import cut

MAX_ROWS = 12_000
MAX_FEATURES = 1 << 16
#: Of the labelled rows, the share that may be toxic: many others make chance findings rare.
TOXIC_PART = 4
#: How many times the others' rate (this keeps out words that only tell a language or a source with more toxic rows than
#: others), findings by chance among all features, and rows that hold a feature for it to be tested.
FACTOR, BY_CHANCE, TESTED = 8.0, 1.0, 3
#: Lengths of prefixes, and counts from which a prefix is a feature of its own.
PREFIXES, TIMES = (4, 5, 6), (2, 4, 8)
GRADES = 3
WORD = re.compile(r"\w+")
ADDED = ("toxic_probability", "expected_severity", "grade", "toxic")


def words(text: str | None) -> Counter:
    out: Counter = Counter()
    out.update(WORD.findall(text.lower()) if text else ())
    return out


def features(text: str | None) -> Iterator[tuple[str, int]]:
    starts: Counter = Counter()
    for w, n in words(text).items():
        yield w, n
        for k in PREFIXES:
            if len(w) > k:
                starts["^" + w[:k]] += n
    for p, n in starts.items():
        yield p, n
        for k in TIMES:
            if n >= k:
                yield f"{p} {k}", 1


def by_chance(a: int, b: int, pos: int, neg: int) -> float:
    """The probability that of the a + b rows that hold a feature, dealt at random, a or more are among the ``pos`` toxic ones."""
    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    n, total = a + b, 0.0
    for k in range(max(a, n - neg), min(n, pos) + 1):
        p = math.exp(log_choose(pos, k) + log_choose(neg, n - k) - log_choose(pos + neg, n))
        total += p
        if p < 1e-9 * total:
            break
    return total


class Ordinal:
    """Weights over named features and ordered thresholds."""

    def __init__(self, names: list[str]):
        self.names, self.at = names, {f: i for i, f in enumerate(names)}
        self.w, self.free = np.zeros(len(names)), np.array([0.0, *[0.0] * (GRADES - 1)])

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        at, n = self.at, Counter()
        for f, c in features(text):
            if f in at:
                n[at[f]] += c
        return np.array(list(n), dtype=np.int64), np.array(list(n.values()), dtype=np.float64)

    @property
    def thresholds(self) -> np.ndarray:
        return self.free[0] + np.concatenate([[0.0], np.cumsum(np.exp(self.free[1:]))])

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES-1, one row for each z."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: float = 0.5, rounds: int = 400, l2: float = 1e-4, rate: float = 0.1) -> None:
        """Full-batch gradient steps with momentum estimates (Adam) on the negative log-likelihood."""
        doc = np.repeat(np.arange(len(rows)), [len(r) for r, _ in rows])
        col, val = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
        weight = np.where(y > 0, share / max(1, (y > 0).sum()), (1 - share) / max(1, (y == 0).sum()))
        theta = np.concatenate([self.w, self.free])
        m, v, k = np.zeros_like(theta), np.zeros_like(theta), len(self.w)
        for t in range(1, rounds + 1):
            self.w, self.free = theta[:k], theta[k:]
            z = np.bincount(doc, weights=self.w[col] * val, minlength=len(rows))
            up = np.concatenate([np.ones((len(y), 1)), self.above(z), np.zeros((len(y), 1))], axis=1)
            here = np.maximum(up[np.arange(len(y)), y] - up[np.arange(len(y)), y + 1], 1e-9)
            d = up * (1 - up)  # derivative of P(grade > k-1) by z
            dz = -(d[np.arange(len(y)), y] - d[np.arange(len(y)), y + 1]) / here * weight
            dt = np.zeros(GRADES)  # by each threshold: P(grade > k) falls as it rises
            for g in range(GRADES):
                dt[g] = ((y == g + 1) * weight * d[:, g + 1] / here).sum() - ((y == g) * weight * d[:, g + 1] / here).sum()
            df = np.array([dt.sum(), *[dt[j:].sum() * np.exp(self.free[j]) for j in range(1, GRADES)]])
            g = np.concatenate([np.bincount(col, weights=val * dz[doc], minlength=k) + l2 * self.w, df])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        self.w, self.free = theta[:k], theta[k:]


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
                  max_rows: int = MAX_ROWS) -> DataFrame:
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    chosen = None
    for y in (0, 1):
        most = max_rows // TOXIC_PART if y else max_rows - max_rows // TOXIC_PART
        part = marked.where((F.col("y") > 0) == bool(y)).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("id", "text", (F.col("y") > 0).alias("y"))


def toxic_share(labels: DataFrame, label: str = "toxic") -> float | None:
    """The share of toxic rows among all labelled ones: the classes' weights, whatever the sample."""
    return labels.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]


def fit(train: DataFrame, share: float | None = 0.5, max_features: int = MAX_FEATURES) -> Ordinal | None:
    """The model, or None unless both classes have rows. ``train`` is bounded; it's cut, so that the three reads
    here read it and not the documents."""
    train = cut(train)
    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(name, int(y)) for text, y in zip(f["text"], f["y"], strict=True) for name in {k for k, _ in features(text)}]
            yield pd.DataFrame(rows, columns=["f", "y"])

    sizes = {bool(r.y): r["count"] for r in train.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    pos, neg = sizes[True], sizes[False]
    counts = train.select("text", "y").mapInPandas(named, "f string, y int").groupBy("f").agg(
        F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    counts = cut(counts.where(F.col("a") + F.col("b") >= TESTED))
    tested = counts.count()

    def taken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["chance"] = [by_chance(a, b, pos, neg) for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True)]
            yield f.loc[f["chance"] * tested <= BY_CHANCE, ["f", "chance"]]

    p, q = (F.col("a") + 0.5) / (pos + 1), (F.col("b") + 0.5) / (neg + 1)
    kept = counts.where(p >= q * FACTOR).mapInPandas(taken, "f string, chance double").orderBy("chance", "f").limit(max_features).collect()
    model = Ordinal([r.f for r in kept])

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [model.row(t) for t in f["text"]]
            yield pd.DataFrame({"id": f["id"], "y": f["y"].astype(bool), "c": [r[0] for r in rows], "v": [r[1] for r in rows]})

    got = train.select(F.col("id").cast("string").alias("id"), "text", "y").mapInPandas(
        vectors, "id string, y boolean, c array<bigint>, v array<double>")
    data = sorted(got.collect(), key=lambda r: r.id)  # max_rows rows at most
    rows = [(np.array(r.c, dtype=np.int64), np.array(r.v)) for r in data]
    evidence = np.array([v.sum() for _, v in rows])
    toxic = np.array([r.y for r in data])
    cuts = thirds(evidence[toxic & (evidence > 0)])
    y = np.where(toxic, 1 + (evidence[:, None] > cuts[None, :]).sum(axis=1), 0)
    model.fit(rows, y, min(max(share or 0.5, 0.01), 0.99))
    return model


def thirds(evidence: np.ndarray) -> np.ndarray:
    """Two cuts of the evidence, each with rows below and above it where there are enough different values."""
    if not len(evidence):
        return np.zeros(2)
    cuts = np.quantile(evidence, [1 / 3, 2 / 3])
    return cuts if evidence.min() <= cuts[0] < cuts[1] < evidence.max() else np.quantile(np.unique(evidence), [1 / 3, 2 / 3])


def severity(docs: DataFrame, model: Ordinal | None, text_col: str = "text") -> DataFrame:
    """``docs`` with toxic_probability, expected_severity (0 to 3), grade (the likeliest) and toxic (0 or 1)."""
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    if model is None:
        zero = F.lit(0.0)
        return docs.select(*own, zero.alias(ADDED[0]), zero.alias(ADDED[1]), F.lit(0).alias(ADDED[2]), F.lit(0).alias(ADDED[3]))

    @F.pandas_udf("toxic_probability double, expected_severity double, grade int")
    def judge(texts: pd.Series) -> pd.DataFrame:
        z = np.array([model.w[c] @ v if len(c) else 0.0 for c, v in map(model.row, texts)], dtype=np.float64)
        up = model.above(z)
        p = -np.diff(np.concatenate([np.ones((len(z), 1)), up, np.zeros((len(z), 1))], axis=1), axis=1)
        return pd.DataFrame({"toxic_probability": up[:, 0], "expected_severity": up.sum(axis=1), "grade": p.argmax(axis=1).astype(np.int32)})

    s = "_severity"
    while s.lower() in {c.lower() for c in docs.columns}:
        s += "_"
    judged = docs.select(*own, judge(F.col(f"`{text_col}`").cast("string")).alias(s))
    return judged.select(*own, *[F.col(f"{s}.{c}").alias(c) for c in ADDED[:3]], (F.col(f"{s}.{ADDED[0]}") >= 0.5).cast("int").alias("toxic"))
