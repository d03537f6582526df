"""Ranked lexical search, a term at a time with a limit on accumulators.

One pass over the documents keeps what the queries' terms need of them: a row for each document with its number of terms
and, for each query term in it, the term's number and its occurrences. N, L and the terms' df are sums over those rows.
Then each task takes its rows in blocks and inverts them. An item's terms come rarest first. Their postings add to the
block's accumulators, and make new ones as long as a document that starts at this term could still reach the item's
50th score so far (of this block's accumulators or of the task's earlier blocks). From there on new documents can't
come in any more and the other terms only update the accumulators that exist. Bounds are sums of each term's largest
contribution in the block. Nothing is rounded, so each block's 50 best are exact, and the best of all blocks' bests are
the result.

Items are searched in groups whose distinct terms number at most ``terms_at_once``, one pass over the documents each; so
what goes to the tasks (terms, weights, items) is bounded. A task holds one block of documents and 50 results an item.

Defined results: null texts, and texts without a term, are no documents here and never found; items without terms have
no rows; rows of one item_id (null is one) are one item with the terms of all; rows of one doc_id are separate
documents, and null ids come first among equal scores; a document as long as may be is one row; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: What a term is made of: ASCII letters and digits and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K = 50
TERMS_AT_ONCE = 50_000
#: Documents that a block holds at most, and postings from which it is full.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 2_000_000
#: Parts that an item's results are ranked in before all of them are.
PARTS = 64
#: UTF-8 bytes with all that isn't part of a term as a space and A-Z in lower case; bytes over 127 are parts of characters beyond ASCII.
TO_TERMS = bytes(b if chr(b).isascii() and chr(b).isalnum() and not chr(b).isupper() else b + 32 if b < 128 and chr(b).isupper() else b if b > 127 else 32 for b in range(256))


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term: each term of an item once."""
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    return items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))).alias("term")).distinct()


def postings(docs: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (terms with repeats), terms (numbers of those in ``terms``) and tf of each document that has a term."""
    number = {t.encode(): i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = number.keys()
        for b in batches:
            ns, lens, ids, tfs = [], [0], [], []
            for text in b.column(1):
                words = text.as_py().translate(TO_TERMS).split() if text.is_valid else ()
                ns.append(len(words))
                count = {}
                for w in words:
                    if w in wanted:
                        count[w] = count.get(w, 0) + 1
                ids += map(number.__getitem__, count)
                tfs += count.values()
                lens.append(len(ids))
            at = pa.array(lens, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (ids, tfs)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *lists], ["id", "n", "terms", "tfs"])
            yield out.filter(pa.array([n > 0 for n in ns], pa.bool_()))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


def _top(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then null ids, then the smallest id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], known[near], -scores[near]))[:k]]


class Block:
    """An inverted block of documents: postings by term, with what each adds to a document's score."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, total: int):
        m = 50 + (50 * n * n_docs) // max(1, total)
        doc = np.repeat(np.arange(len(n)), sizes)
        by = np.argsort(terms, kind="stable")
        self.docs, terms, tfs = doc[by], terms[by], tfs[by]
        self.adds = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[self.docs]))
        self.starts = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), dtype=np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.adds, self.starts[held])
        self.scores = np.zeros(len(n), dtype=np.int64)
        self.made = 0

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all documents that may be among an item's k best; ``terms`` rarest first, ``floor``: a score that k documents reach elsewhere."""
        terms = terms[self.most[terms] > 0]
        rest = np.cumsum(self.most[terms][::-1])[::-1]
        score, open_, alive = self.scores, True, np.zeros(0, dtype=np.int64)
        for t, bound in zip(terms.tolist(), rest.tolist(), strict=True):
            docs, adds = self.docs[self.starts[t] : self.starts[t + 1]], self.adds[self.starts[t] : self.starts[t + 1]]
            if open_:
                # a document without an accumulator gets ``bound`` at most; equal scores may still win by their id
                kth = floor
                if len(alive) >= k:
                    kth = max(kth, int(np.partition(score[alive], len(alive) - k)[len(alive) - k]))
                open_ = bound >= kth
            if open_:
                alive = np.concatenate([alive, docs[(score[docs] == 0) & (adds > 0)]])
                score[docs] += adds
            else:
                kept = score[docs] > 0
                score[docs[kept]] += adds[kept]
        self.made += len(alive)
        out = score[alive]
        score[alive] = 0
        return alive, out


def search(docs: DataFrame, items: DataFrame, k: int = K, terms_at_once: int = TERMS_AT_ONCE, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """item_col, rank, id_col, score: each item's k documents with the highest scores above 0."""
    asked = materialise(item_terms(items, item_col, text_col), "search-items")
    # items in the order of their first term, cut where a group's terms reach the bound
    out, spark = None, docs.sparkSession
    sizes = asked.groupBy("item").agg(F.count("*").alias("c")).withColumn("g", F.floor((F.sum("c").over(Window.orderBy(F.col("item").asc_nulls_first())) - F.col("c")) / terms_at_once))
    groups = [r.g for r in sizes.select("g").distinct().orderBy("g").collect()]  # as many as passes
    for g in groups:
        some = asked if len(groups) == 1 else asked.alias("a").join(sizes.where(F.col("g") == g).alias("s"), F.col("a.item").eqNullSafe(F.col("s.item")), "left_semi")
        found = _search_group(docs, some.collect(), k, block_docs, id_col, text_col)  # at most terms_at_once rows and those of one item
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item long, id long, score long, part int")
    order = [F.desc("score"), F.col("id").asc_nulls_first()]
    first = out.withColumn("_r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("_r") <= k)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_group(docs: DataFrame, asked: list, k: int, block_docs: int, id_col: str, text_col: str) -> DataFrame:
    names = sorted({r.term for r in asked})
    place = {t: i for i, t in enumerate(names)}
    rows = materialise(postings(docs, names, id_col, text_col), "search-postings")
    n_docs, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = np.zeros(len(names), dtype=np.int64)
    for t, c in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each term asked for
        df[t] = c
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0))).astype(np.int64)
    by_item: dict = {}
    for r in asked:
        by_item.setdefault(r.item, []).append(place[r.term])
    wanted = [(i, np.array(sorted((t for t in ts if df[t]), key=lambda t: (df[t], t)), dtype=np.int64)) for i, ts in by_item.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(wanted)
        for b in _blocks(batches, block_docs):
            ids, known = b.column(0).fill_null(0).to_numpy(), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            flat = lambda c: c.flatten().to_numpy().astype(np.int64)
            block = Block(b.column(1).to_numpy(), np.diff(b.column(2).offsets.to_numpy()), flat(b.column(2)), flat(b.column(3)), weights, n_docs, total)
            for i, (_, terms) in enumerate(wanted):
                had = best[i]
                at, score = block.search(terms, k, int(had[2][-1]) if len(had[2]) == k else 0)
                if len(at):
                    joined = np.concatenate([had[0], ids[at]]), np.concatenate([had[1], known[at]]), np.concatenate([had[2], score])
                    top = _top(*joined, k)
                    best[i] = tuple(x[top] for x in joined)
        for (item, _), (ids, known, score) in zip(wanted, best, strict=True):
            if len(ids):
                yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(ids), pa.int64()), "id": pa.array(ids, pa.int64(), mask=~known), "score": pa.array(score, pa.int64())})

    return rows.mapInArrow(run, "item long, id long, score long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))


def _blocks(batches: Iterator[pa.RecordBatch], block_docs: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to blocks of at most so many documents, fewer where their postings are many."""
    held, size, posts = [], 0, 0
    for b in chain.from_iterable((b.slice(lo, block_docs) for lo in range(0, b.num_rows, block_docs)) for b in batches):
        if held and (size + b.num_rows > block_docs or posts >= BLOCK_POSTINGS):
            yield pa.concat_batches(held)
            held, size, posts = [], 0, 0
        held.append(b)
        size += b.num_rows
        posts += len(b.column(2).flatten())
    if held:
        yield pa.concat_batches(held)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Both sides write a term's pattern alike; letters are folded before it is applied, as folding makes no other character part of a term.
OP13_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
docs AS (SELECT row, doc_id, len(ts) AS n, ts FROM words WHERE len(ts) > 0),
whole AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
posts AS (SELECT row, any_value(doc_id) AS doc_id, any_value(n)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
dfs AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM posts, whole GROUP BY term, nn),
scores AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN posts USING (term) JOIN dfs USING (term), whole GROUP BY item_id, row)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 50"""
