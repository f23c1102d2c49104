"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators of n-grams (one to three long) of the text's shape: bytes become sixteen
character classes (capital, small, digit, space, line end, kinds of punctuation), runs of a class become
one, and an n-gram has an indicator for each share of the text that it reaches (:data:`SHARES`). Word
bigrams that repeat one word have indicators of their own. Each indicator is scaled by its
log-count ratio between the classes, and a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent.

Fitting reads at most ``max_rows`` labelled rows (half of each class, those first in hash order; the bound is
this parameter) and only rows that aren't held out; their indicators, not their texts, come to the
driver. Scoring is one narrow pass over every whole text.

Defined results: null and empty texts have only the bias and get a score as any other; rows with null ids
are scored (they aren't held out); repeated rows get equal scores; labels that conflict count as the lower one; with labels of
one class only, or none, every score is that class's (0, 1, or 0.5 without labels); an empty table gives an empty
result; other columns pass through, and those named like an added one, in any case, are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 6000
SHARES = (0.0, 0.01, 0.05, 0.2)
N_CLASSES = 16
SIZES = tuple(N_CLASSES ** n for n in (1, 2, 3))
REPEATS = (0.02, 0.1, 0.3)
N_FEATURES = len(SHARES) * sum(SIZES) + len(REPEATS)
#: Texts are cut into slices of this many bytes for counting, so that a long one needs bounded memory.
SLICE = 1 << 20


def _classes() -> bytes:
    kinds = ["\n", " \t\r\x0b\x0c", ".", ",", ";:", "!", "?", "|", "-_", "\"'`", "()[]{}", "*#$%&<>=+~^@/\\"]
    table = bytearray([15] * 256)
    for k, chars in enumerate(kinds):
        for c in chars:
            table[ord(c)] = k
    for c in range(256):
        if 65 <= c <= 90:
            table[c] = 12
        elif 97 <= c <= 122 or c >= 128:
            table[c] = 13
        elif 48 <= c <= 57:
            table[c] = 14
    return bytes(table)


CLASSES = _classes()


def indicators(text: bytes | None) -> np.ndarray:
    """The sorted numbers of the indicators that a text sets."""
    out, first = [], 0
    counts, total = [np.zeros(s, dtype=np.int64) for s in SIZES], 0
    same = pairs = 0
    text, last = text or b"", b""
    for lo in range(0, len(text), SLICE):
        part = text[lo:lo + SLICE]
        c = np.frombuffer(part.translate(CLASSES), dtype=np.uint8).astype(np.int64)
        c = c[np.concatenate([[True], c[1:] != c[:-1]])]
        code = c
        for n in range(3):
            if n:
                code = code[:-1] * N_CLASSES + c[n:]
            counts[n] += np.bincount(code, minlength=SIZES[n])
        total += len(c)
        ws = [last, *part.lower().split()] if last else part.lower().split()
        same += sum(map(bytes.__eq__, ws, ws[1:]))
        pairs += max(0, len(ws) - 1)
        last = ws[-1] if ws else last
    for n in range(3):
        seen = np.flatnonzero(counts[n])
        share = counts[n][seen] / max(total, 1)
        for s in SHARES:
            out.append(first + seen[share > s])
            first += SIZES[n]
    out.append(first + np.arange(sum(same > r * pairs for r in REPEATS)))
    return np.concatenate(out).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                  max_rows: int = MAX_ROWS) -> DataFrame:
    """(text as bytes, label) of at most ``max_rows`` labelled rows that aren't held out, half of each class."""
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(
        F.col(id_col).alias("id")).agg(F.min(label).alias("y"))
    chosen = None
    for y in (0, 1):
        part = marked.where((F.col("y") > 0) == bool(y)).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("id", "text", "y")


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, n: int, smooth: float = 1.0) -> np.ndarray:
    sums = [smooth + np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *[r for r, k in zip(rows, y, strict=True) if (k > 0) == side]]),
                                 minlength=n) for side in (True, False)]
    return np.log(sums[0] / sums[0].sum()) - np.log(sums[1] / sums[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 0.1, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model over ``scale``-d indicators."""
    rng, w, bias = np.random.default_rng(11), np.zeros(len(scale)), 0.0
    alpha, norm = np.zeros(len(rows)), np.array([1.0 + (scale[r] ** 2).sum() for r in rows])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, x = rows[i], scale[rows[i]]
            slope = y[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4 * c:
            break
    return w, bias


def fit(train: DataFrame) -> tuple[np.ndarray, float] | float:
    """(weights of the indicators, bias); or the only class there is."""
    @F.pandas_udf("array<bigint>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(indicators)

    got = train.select("id", features("text").alias("f"), "y").collect()  # max_rows rows at most
    got.sort(key=lambda r: r.id)
    rows, y = [np.array(r.f, dtype=np.int64) for r in got], np.array([1.0 if r.y > 0 else -1.0 for r in got])
    if not len(y) or (y == y[0]).all():
        return 0.5 if not len(y) else float(y[0] > 0)
    ratios = log_count_ratios(rows, y, N_FEATURES)
    w, bias = dual_coordinate_descent(rows, y, ratios)
    return w * ratios, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float] | float, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; higher: label 1 is likelier) and ``predicted``."""
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    if isinstance(model, float):
        return docs.select(*own, F.lit(model).alias("score"), F.lit(int(model >= 0.5)).alias("predicted"))
    weights, bias = model

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        margin = np.array([weights[indicators(t)].sum() + bias for t in texts], dtype=np.float64)
        return pd.Series(1 / (1 + np.exp(-2 * np.clip(margin, -300, 300))))

    scored = docs.select(*own, score_of(F.col(f"`{text_col}`").cast("string").cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
