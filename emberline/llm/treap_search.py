"""Ranked lexical search over inverted treaps.

Each block of documents gets an inverted index: a treap for each term, in search order by document and in heap order by
impact, so that the root of any subtree carries the largest impact in it. Queries walk the treaps of their terms
together. A walk holds intervals of documents, each with the highest node of every term inside it; the sum of these
nodes' impacts bounds the score of all documents of the interval, and an interval whose bound is below the k-th score
found so far is dropped with all its subtrees. Otherwise the document of the largest impact is looked up in the treaps
and scored, and splits the interval in two. Levels of the walks of many queries are worked on at once, as arrays.

Queries are taken in blocks of at most MAX_TERMS different terms (or one query), which are broadcast; documents are
counted whole, but only postings of those terms are kept. Postings aren't shuffled: a block is what a task reads, up to
BLOCK_POSTINGS, and only k rows a query and block go on to the merge. Document frequencies, lengths and their sums are
of all documents.

Defined results: terms are maximal runs of ASCII letters, digits and all other characters beyond ASCII, with only A to Z
lower-cased; a null or empty text has none and is never found, and a query without terms finds nothing; rows that repeat an id are
documents (or queries) of their own, and equal scores go by ascending id, null last; very long texts are read whole; an
empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.shared import place, plain, stage, table

K = 10
#: Different terms of the queries that are searched at once; postings of a block; queries whose walks are one array.
MAX_TERMS, BLOCK_POSTINGS, TOGETHER = 1 << 18, 1 << 21, 16
#: Bytes of terms: digits, letters (A to Z become a to z) and all of characters beyond ASCII; others divide terms.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def term_weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


# -------------------------------------------------------------------- index


def priorities(n: int) -> np.ndarray:
    """Pseudo-random numbers that order equal impacts, so that treaps of equal documents stay balanced."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) >> np.uint64(40)


def treap(impacts: list[int], order: list[int], first: int, nil: int, left: np.ndarray, right: np.ndarray) -> int:
    """Link the postings from `first` on, sorted by document, into one treap; its root. Ends of links are nil."""
    spine: list[int] = []  # from the root along right links
    lefts, rights = [nil] * len(impacts), [nil] * len(impacts)
    for k, own in enumerate(zip(impacts, order)):
        under = nil
        while spine and (impacts[spine[-1]], order[spine[-1]]) < own:
            under = spine.pop() + first
        lefts[k] = under
        if spine:
            rights[spine[-1]] = k + first
        spine.append(k)
    left[first : first + len(impacts)], right[first : first + len(impacts)] = lefts, rights
    return spine[0] + first


class TreapIndex:
    """Treaps of the terms of one block of documents: term, doc (0, 1, ... in order) and impact of each posting."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        by = np.lexsort((doc, term))
        term, self.nil = term[by], len(by)
        self.doc = np.append(doc[by], -1)
        self.impact = np.append(impact[by], 0)
        self.left, self.right = np.full(self.nil + 1, self.nil), np.full(self.nil + 1, self.nil)
        names, first = np.unique(term, return_index=True)
        order = priorities(self.nil)
        self.roots: dict[int, int] = {}
        for t, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), self.nil]):
            self.roots[t] = treap(self.impact[a:b].tolist(), order[a:b].tolist(), a, self.nil, self.left, self.right)

    def inside(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The highest node of each subtree whose document is within low and high, else nil."""
        node = node.copy()
        open_ = np.flatnonzero(node != self.nil)
        while len(open_):
            at = node[open_]
            over, under = self.doc[at] > high[open_], self.doc[at] < low[open_]
            moved = over | under
            open_, at, over = open_[moved], at[moved], over[moved]
            node[open_] = np.where(over, self.left[at], self.right[at])
            open_ = open_[node[open_] != self.nil]
        return node

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """query, doc and score of the k best documents of each query (its terms and how often it has each), best first;
        of equal scores the smaller doc. Also how many documents were scored."""
        of = np.array([q for q, (terms, _) in enumerate(queries) for t in terms.tolist() if t in self.roots], np.int64)
        node = np.array([self.roots[t] for terms, _ in queries for t in terms.tolist() if t in self.roots], np.int64)
        times = np.array([n for terms, times in queries for t, n in zip(terms.tolist(), times.tolist()) if t in self.roots], np.int64)
        some, span = np.unique(of, return_inverse=True)  # span: the interval of each node
        query, low, high = some, np.zeros(len(some), np.int64), np.full(len(some), int(self.doc.max(initial=0)))
        best = np.empty((3, 0), np.int64)  # query, doc, score
        least = np.ones(len(queries), np.int64)  # a score below can't enter
        scored = 0
        while len(node):
            value = self.impact[node] * times
            first = np.flatnonzero(np.append(True, span[1:] != span[:-1]))
            keep = np.add.reduceat(value, first) >= least[query]
            held = keep[span]
            span, node, times, value = (np.cumsum(keep) - 1)[span[held]], node[held], times[held], value[held]
            query, low, high = query[keep], low[keep], high[keep]
            if not len(node):
                break
            first = np.flatnonzero(np.append(True, span[1:] != span[:-1]))
            top = np.flatnonzero(value == np.maximum.reduceat(value, first)[span])
            top = top[np.append(True, span[top][1:] != span[top][:-1])]
            split = self.doc[node[top]]
            at = split[span]
            score = np.add.reduceat(self.impact[self.inside(node, at, at)] * times, first)
            scored += len(split)
            best = np.concatenate((best, np.stack((query, split, score))), axis=1)
            best = best[:, best[2] > 0]
            best = best[:, np.lexsort((best[1], -best[2], best[0]))]
            start = np.flatnonzero(np.append(True, best[0][1:] != best[0][:-1])) if best.shape[1] else np.empty(0, np.int64)
            nth = np.arange(best.shape[1]) - np.repeat(start, np.diff(np.append(start, best.shape[1])))
            best, nth = best[:, nth < k], nth[nth < k]
            least[best[0][nth == k - 1]] = best[2][nth == k - 1]
            # what lies before and behind the document that was scored
            both = np.concatenate((self.inside(node, low[span], at - 1), self.inside(node, at + 1, high[span])))
            there = both != self.nil
            span = np.concatenate((2 * span, 2 * span + 1))[there]
            node, times = both[there], np.concatenate((times, times))[there]
            by = np.argsort(span, kind="stable")
            some, span = np.unique(span[by], return_inverse=True)
            node, times, parent, behind = node[by], times[by], some >> 1, some & 1 == 1
            query, low, high = query[parent], np.where(behind, split[parent] + 1, low[parent]), np.where(behind, high[parent], split[parent] - 1)
        return best[0], best[1], best[2], scored


# -------------------------------------------------------------------- spark


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """id, n (terms of the document), terms and tfs (numbers and occurrences of those in the vocabulary) of each row."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                found = {number[w]: n for w, n in Counter(words).items() if w in number}
                sizes.append(len(words))
                terms.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"])

    texts = plain(docs).select(F.col(place(docs, id_col)).alias("id"), F.col(place(docs, text_col)).cast("binary").alias("text"))
    return texts.mapInArrow(of, f"id {kind}, n long, terms array<int>, tfs array<long>")


def block_index(rows: pa.Table, weight: np.ndarray, documents: int, terms_in_all: int) -> tuple[TreapIndex, pa.Array]:
    """The treaps of rows of postings, and the ids of the documents as they are numbered there."""
    rows = rows.take(pc.sort_indices(rows.column("id"), null_placement="at_end"))
    lists = rows.column("terms").combine_chunks()
    term, tf = lists.flatten().to_numpy(), rows.column("tfs").combine_chunks().flatten().to_numpy()
    doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
    m = 25 + (75 * rows.column("n").to_numpy() * documents) // max(terms_in_all, 1)
    return TreapIndex(term, doc, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))), rows.column("id")


def best_of_blocks(posted: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, documents: int, terms_in_all: int, k: int, block_postings: int) -> DataFrame:
    """query (its number), id and score of the k best documents of each query in each block."""
    shared = posted.sparkSession.sparkContext.broadcast((queries, weight))
    kind = posted.schema["id"].dataType.simpleString()

    def walked(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        index, ids = block_index(pa.Table.from_batches(batches), weights, documents, terms_in_all)
        for a in range(0, len(asked), TOGETHER):
            query, doc, score, _ = index.search(asked[a : a + TOGETHER], k)
            yield pa.RecordBatch.from_arrays([pa.array(query + a), ids.take(pa.array(doc)).combine_chunks(), pa.array(score)], ["query", "id", "score"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= block_postings:
                yield from walked(held)
                held, size = [], 0
        if size:
            yield from walked(held)

    return posted.where(F.size("terms") > 0).mapInArrow(of, f"query long, id {kind}, score long")


def query_blocks(items: DataFrame, max_terms: int) -> Iterator[list[tuple[Row, Counter]]]:
    """Queries and their terms, in blocks of at most max_terms different ones, or one query."""
    block: list[tuple[Row, Counter]] = []
    seen: set[bytes] = set()
    for row in items.toLocalIterator():
        terms = Counter(terms_of(bytes(row["text"]) if row["text"] is not None else None))
        if block and len(seen | terms.keys()) > max_terms:
            yield block
            block, seen = [], set()
        block.append((row, terms))
        seen |= terms.keys()
    if block:
        yield block


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_terms: int = MAX_TERMS, block_postings: int = BLOCK_POSTINGS
) -> DataFrame:
    """item, rank (from 1), id and score of the k best documents of each row of items."""
    spark = docs.sparkSession
    asked = stage(plain(items).select(F.col(place(items, item_col)).alias("item"), F.col(place(items, item_text_col)).cast("binary").alias("text")))
    shape = f"item {asked.schema['item'].dataType.simpleString()}, rank int, id {docs.schema[id_col].dataType.simpleString()}, score long"
    out = spark.createDataFrame([], shape)
    for block in query_blocks(asked, max_terms):
        vocabulary = {w: k for k, w in enumerate(sorted(set().union(*(terms.keys() for _, terms in block))))}
        posted = stage(postings(docs, id_col, text_col, vocabulary))
        documents, terms_in_all = posted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = posted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most one row a term of the block
        weight = np.zeros(len(vocabulary), np.int64)
        for term, n in frequency:
            weight[term] = term_weight(documents, n)
        queries = [(np.array([vocabulary[w] for w in terms], np.int64), np.array(list(terms.values()), np.int64)) for _, terms in block]
        found = best_of_blocks(posted, queries, weight, documents, terms_in_all, k, block_postings)
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, row["item"]) for q, (row, _) in enumerate(block)], f"query long, item {asked.schema['item'].dataType.simpleString()}")
        out = out.unionByName(stage(ranked.join(F.broadcast(names), "query").select("item", "rank", "id", "score")))
    return out


def op11_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY 1),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, a WHERE term IN (SELECT term FROM qt) GROUP BY term, docs),
m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM n, a),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM qt JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
