"""Ranked lexical search: the best documents of every query, by term-at-a-time and document-at-a-time together.

Scores are sums over a query's terms of an integer weight times a saturated, length-normalised frequency
(the fixed values below); N, L and df are counted over all documents in one pass, and a second pass searches.

Method. Documents stay where they are: each task turns its documents into shards, inverted lists of the
queries' terms with their score contributions. A query runs over a shard in two steps. Its short lists are
merged term at a time into summed accumulators. These then stand as one iterator, whose bound is the largest
accumulator, beside the long lists, each bounded by its largest contribution. Document at a time, in ranges of
documents that double, the iterators whose bounds together stay below the score of the k-th best so far are
not walked: documents come from the others, and the rest are only skipped to for documents that can still get in.
A task hands on k documents a query at most; a window over the queries ranks these.

The queries' terms and weights are broadcast in blocks of at most ``block_terms`` words; more queries pass
over the documents block by block. A shard holds at most ``shard_postings`` postings (a longer document is a
shard of its own), so memory is bounded by neither the table nor a partition.

Defined results: null or empty texts have no term, count nowhere and are never found. Queries without terms, or whose
terms no document has, have no rows. Every query row and every document row counts on its own, equal ids included;
equal scores go by ascending id, null ids last. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
BLOCK_TERMS = 1_000_000
SHARD_POSTINGS = 1 << 21
#: Short lists: those that together hold at most a SHORT-th of the shard's documents.
SHORT = 8
#: Documents in the first range.
RANGE = 512
#: A-Z to a-z; ASCII characters other than digits and letters to a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, n_docs: int, n_terms: int) -> int:
    return 25 + 75 * n * n_docs // n_terms


class Shard:
    """Inverted lists of the queries' terms over some documents, in ascending order of their ids."""

    def __init__(self, ids: pa.Array, norms: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        order = pc.array_sort_indices(ids).to_numpy()  # nulls last
        self.ids, place = ids.take(pa.array(order)), np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        doc = place[doc]
        by = np.lexsort((doc, term))
        self.doc, term, tf = doc[by], term[by], tf[by]
        self.score = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norms[order][self.doc]))
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))

    def lists(self, query: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(documents, contributions) of each term of ``query`` (term, times) that occurs here."""
        spans = [(self.start[t], self.start[t + 1], times) for t, times in query]
        return [(self.doc[a:b], self.score[a:b] * times) for a, b, times in spans if b > a]


def summed(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document once, with the sum of its scores, in ascending order."""
    by = np.argsort(docs, kind="stable")
    docs, scores = docs[by], scores[by]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return docs[first], np.add.reduceat(scores, first) if len(first) else scores


def best_of(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, top: int, floor: int = 1, short: int = SHORT,
            first_range: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``top`` best of a shard, best first, equal scores by document.

    Only documents that score ``floor`` or more are looked for: that of the k-th best known elsewhere.
    """
    lists = sorted(lists, key=lambda x: len(x[0]))
    held = np.cumsum([len(d) for d, _ in lists])
    n_short = int(np.searchsorted(held, max(n_docs // short, first_range), side="right"))
    iterators = lists[n_short:]
    if n_short:  # term at a time
        iterators = [summed(np.concatenate([d for d, _ in lists[:n_short]]), np.concatenate([s for _, s in lists[:n_short]])), *iterators]
    iterators = sorted(((d, s, int(s.max())) for d, s in iterators), key=lambda x: x[2])
    bounds = np.cumsum([0, *(b for _, _, b in iterators)])  # of the first i iterators together
    docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lo, size = 0, first_range
    while lo < n_docs:  # document at a time
        hi, size = min(n_docs, lo + size), size * 2
        walked = int(np.searchsorted(bounds[1:], floor, side="left"))  # the first whose bounds together reach the floor
        if walked == len(iterators):
            break
        cuts = [slice(*np.searchsorted(d, (lo, hi))) for d, _, _ in iterators[walked:]]
        found, got = summed(np.concatenate([d[c] for (d, _, _), c in zip(iterators[walked:], cuts, strict=True)]),
                            np.concatenate([s[c] for (_, s, _), c in zip(iterators[walked:], cuts, strict=True)]))
        for i in range(walked - 1, -1, -1):  # skipped to, the greatest bound first
            live = got + bounds[i + 1] >= floor
            found, got = found[live], got[live]
            if not len(found):
                break
            d, s, _ = iterators[i]
            at = np.minimum(np.searchsorted(d, found), len(d) - 1)
            got = got + np.where(d[at] == found, s[at], 0)
        live = got >= floor
        docs, scores = np.concatenate([docs, found[live]]), np.concatenate([scores, got[live]])
        by = np.lexsort((docs, -scores))[:top]
        docs, scores = docs[by], scores[by]
        if len(docs) == top:
            floor = max(floor, int(scores[-1]))
        lo = hi
    return docs, scores


def _blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[list]:
    """(row number, id, Counter of terms) of the queries, in blocks of about ``block_terms`` words."""
    block, size, row = [], 0, 0
    for r in items.where(F.col(f"`{text_col}`").isNotNull()).select(
            F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).toLocalIterator():
        found = Counter(terms(r.t.encode()))
        if found:
            block.append((row, r.i, found))
            row, size = row + 1, size + len(found)
        if size >= block_terms:
            yield block
            block, size = [], 0
    if block:
        yield block


def _counted(shared):
    """(term number, documents that hold it); -1: documents with a term, -2: terms with repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        get, df, n_docs, n_terms = vocab.get, np.zeros(len(vocab) + 1, dtype=np.int64), 0, 0
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                ws = terms(t.as_py())
                n_docs += bool(ws)
                n_terms += len(ws)
                df[np.unique(np.fromiter(map(get, ws, repeat(-1)), dtype=np.int64, count=len(ws)))] += 1
        some = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[n_docs, n_terms], df[some]]))],
                                         names=["term", "n"])
    return run


def _searched(shared, top: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights, queries, n_docs, n_terms = shared.value
        get, best = vocab.get, {}  # by query: (scores, ids) of the task's best so far
        ids, norms, parts, held, kind = [], [], [], 0, None

        def search() -> None:
            doc, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
            shard = Shard(pa.array(ids, type=kind), np.array(norms, dtype=np.int64), doc, term, tf, weights)
            for q, query in enumerate(queries):
                lists = shard.lists(query)
                if not lists:
                    continue
                old_scores, old_ids = best.get(q, (np.zeros(0, dtype=np.int64), pa.array([], type=kind)))
                floor = int(old_scores[-1]) if len(old_scores) == top else 1
                docs, scores = best_of(lists, len(ids), top, max(1, floor))
                if len(docs):
                    both = pa.concat_arrays([old_ids, shard.ids.take(pa.array(docs))])
                    scores = np.concatenate([old_scores, scores])
                    place = np.empty(len(both), dtype=np.int64)
                    place[pc.array_sort_indices(both).to_numpy()] = np.arange(len(both))
                    by = np.lexsort((place, -scores))[:top]
                    best[q] = scores[by], both.take(pa.array(by))

        for b in batches:
            kind = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                ws = terms(t.as_py())
                known = np.fromiter(map(get, ws, repeat(-1)), dtype=np.int64, count=len(ws))
                term, tf = np.unique(known[known >= 0], return_counts=True)
                if not len(term):
                    continue
                parts.append((np.full(len(term), len(ids)), term, tf))
                ids.append(i)
                norms.append(length_norm(len(ws), n_docs, n_terms))
                held += len(term)
                if held >= shard_postings:
                    search()
                    ids, norms, parts, held = [], [], [], 0
        if parts:
            search()
        for q, (scores, found) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, dtype=np.int64)), found, pa.array(scores)],
                                             names=["q", "id", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, id_col, score): the ``top`` best documents with a score above 0 of every query row."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string").alias("t")
    named = docs.select(F.col(f"`{id_col}`").alias("id"), text)
    item_kind = items.schema[item_id].dataType
    out = spark.createDataFrame([], f"item {item_kind.simpleString()}, rank int, id {kind}, score bigint")
    for block in _blocks(items, item_id, item_text, block_terms):
        vocab = {w: i for i, w in enumerate(sorted({w for _, _, found in block for w in found}))}
        shared = spark.sparkContext.broadcast(vocab)
        counts = {r.term: r.n for r in named.select("t").mapInArrow(_counted(shared), "term bigint, n bigint").groupBy("term").agg(
            F.sum("n").alias("n")).collect()}  # the block's terms at most
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        weights = np.array([weight(n_docs, counts.get(t, 0)) for t in range(len(vocab))], dtype=np.int64)
        queries = [[(vocab[w], times) for w, times in found.items() if vocab[w] in counts] for _, _, found in block]
        task = spark.sparkContext.broadcast((vocab, weights, queries, n_docs, n_terms))
        hits = named.mapInArrow(_searched(task, top, shard_postings), f"q bigint, id {kind}, score bigint")
        w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        names = F.broadcast(spark.createDataFrame([(q, i) for q, (_, i, _) in enumerate(block)], f"q bigint, item {item_kind.simpleString()}"))
        out = out.unionByName(ranked.join(names, "q").select("item", "rank", "id", "score"))
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(id_col), "score")


def duckdb_sql(top: int = TOP) -> str:
    """The same result from ``documents`` and ``benchmark``, every document scored."""
    def split(text: str) -> str:
        upper = "".join(map(chr, range(65, 91)))
        return f"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{upper.lower()}'), '{TERM_PATTERN}')"

    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {split('text')} AS t FROM documents),
total AS MATERIALIZED (SELECT count(*) AS nd, CAST(sum(len(t)) AS BIGINT) AS nt FROM d WHERE len(t) > 0),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
q AS (SELECT item_id, unnest({split('text')}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {top}"""
