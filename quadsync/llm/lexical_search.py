"""Operator 12: ranked lexical search by an exact sparse ball tree.

A document is a sparse vector d over its terms, ``d = 10^9 tf div (1000 tf + 8 m)``, an
item one of weights q, ``q = repeats * floor(1000 ln((2N + 2) / (2 df + 1)))``; the score is
their inner product.  N, the sum of all lengths and the items' document frequencies
are counted over all documents.

Index: documents lie in blocks of about ``BLOCK_ROWS``; a block has a ball tree with
leaves of ``LEAF`` documents, each node a centroid c and radii r.  For any document of a
node

    <q, d> <= <q, c> + sum over bands b of |q restricted to b and the node's terms| * r_b

where bands divide the terms and r_b is the largest distance to the centroid within
band b.  Terms that no document of a node holds don't count for it.  Bounds are
rounded up by more than doubles can lose.

Search: in each block nodes are opened best bound first; leaves are scored in whole
numbers.  A first pass opens the best leaves of each block only; its k-th best score over
all blocks is a bound from below for the second pass, which drops every subtree
whose bound stays below that or below the k-th best of its own block.

Only terms that occur in items matter for a product; a Bloom filter of fixed size
keeps the others out of the vectors (a term that slips through is harmless).  Items go
to the blocks in parts of about ``PART_TERMS`` terms, so a part is small whatever the
number of items; the index is never shuffled.

Cases: null and empty texts have no terms, score 0 and never appear, nor does a
document without id (it still counts for N, lengths and frequencies); rows
with equal ids are ranked each; equal scores go by ascending id; items that
repeat or have no id are answered each, items without terms or with
no document above 0 give no rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadsync.llm.bloom import marked, passes
from quadsync.llm.shared import store, table
from quadsync.llm.text_arrays import mix
from quadsync.session import ship_package

K = 10
BLOCK_ROWS = 4096
#: entries of a block's vectors, whatever its documents' length
BLOCK_ENTRIES = 1 << 20
LEAF = 8
BANDS = 64
FIRST_LEAVES = 4
PART_TERMS = 100_000
ROWS_AT_ONCE = 256
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


def term_keys(words: list[bytes]) -> np.ndarray:
    """64-bit keys for the filter."""
    return mix(np.fromiter((hash64(w) for w in words), np.uint64, len(words))).view(np.int64)


def hash64(word: bytes) -> int:
    h = 0xCBF29CE484222325
    for i in range(0, len(word), 8):
        h = (h ^ int.from_bytes(word[i:i + 8], "little") ^ (len(word) << 56)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h


# -- vectors -------------------------------------------------------------------------------------------------

def count_terms(marks) -> Callable:
    """(doc_id, text) -> (doc_id, n, terms, tfs) with the terms that pass the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = marks.value, {}
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(a, ROWS_AT_ONCE)
                n, words, tfs = [], [], []
                for text in some.column(1).to_pylist():
                    found = terms(text)
                    n.append(len(found))
                    tf = Counter(found)
                    if len(known) > 1 << 20:
                        known.clear()
                    if new := [w for w in tf if w not in known]:
                        known.update(zip(new, passes(term_keys(new), bits).tolist(), strict=True))
                    mine = [w for w in tf if known[w]]
                    words.append(mine)
                    tfs.append([tf[w] for w in mine])
                yield pa.record_batch([some.column(0), pa.array(n, pa.int64()), pa.array(words, pa.list_(pa.binary())), pa.array(tfs, pa.list_(pa.int64()))],
                                      names=["doc_id", "n", "terms", "tfs"])
    return run


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times), one row per item and term; ``item`` is the row's own number."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, item_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tf = Counter(terms(text))
                if tf:
                    yield pa.record_batch([pa.array([item] * len(tf)), pa.array([item_id] * len(tf), b.schema.field(1).type), pa.array(list(tf), pa.binary()), pa.array(list(tf.values()), pa.int64())],
                                          names=["item", "item_id", "term", "times"])
    kind = items.schema["item_id"].dataType.simpleString()
    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(split, f"item long, item_id {kind}, term binary, times long")


def weight(total: Column, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((total * 2 + 2).cast("double") / (df * 2 + 1).cast("double"))).cast("long")


# -- ball tree -----------------------------------------------------------------------------------------------

class Block:
    """Documents of a block as rows of a sparse matrix in the order of the tree's leaves.

    first, last: rows of a node; left: its left child (the right one follows), -1 for a leaf.
    """

    def __init__(self, ids: list[int], words: list[list[bytes]], values: list[list[int]]):
        names = sorted({w for ws in words for w in ws})
        place = {w: i for i, w in enumerate(names)}
        self.place, self.width = place, len(names)
        ptr = np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)
        cols = np.fromiter((place[w] for ws in words for w in ws), np.int64, ptr[-1])
        vals = np.fromiter((v for vs in values for v in vs), np.int64, ptr[-1])
        held = np.bincount(cols, minlength=self.width)
        # terms of like frequency share a band
        self.band = np.empty(self.width, np.int64)
        self.band[np.argsort(held, kind="stable")] = np.arange(self.width) * BANDS // max(1, self.width)
        rows, first, last, left = self._split(ptr, cols, vals.astype(np.float64))
        lens = np.diff(ptr)[rows]
        at = np.repeat(ptr[rows] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        self.ids, self.cols, self.vals = np.array(ids, np.int64)[rows], cols[at], vals[at]
        self.ptr = np.append(0, np.cumsum(lens)).astype(np.int64)
        self.first, self.last, self.left = np.array(first), np.array(last), np.array(left)
        self._balls()

    @staticmethod
    def _split(ptr: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, list[int], list[int], list[int]]:
        """Each node is parted by two documents far from each other (first the one farthest
        from the centroid, then the one farthest from it), evenly where one side would be almost empty."""
        n, width = len(ptr) - 1, int(cols.max(initial=-1)) + 1
        norm2 = np.add.reduceat(np.append(vals * vals, 0), ptr[:-1]) * (np.diff(ptr) > 0)
        order, first, last, left = np.arange(n), [0], [n], [-1]
        todo = [0]

        def products(rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
            lens = np.diff(ptr)[rows]
            at = np.repeat(ptr[rows] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            return np.bincount(np.repeat(np.arange(len(rows)), lens), vals[at] * dense[cols[at]], len(rows))

        def dense_of(row: int) -> np.ndarray:
            d = np.zeros(width)
            d[cols[ptr[row]:ptr[row + 1]]] = vals[ptr[row]:ptr[row + 1]]
            return d

        while todo:
            node = todo.pop()
            a, b = first[node], last[node]
            rows = order[a:b]
            if b - a <= LEAF:
                continue
            lens = np.diff(ptr)[rows]
            at = np.repeat(ptr[rows] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            c = np.bincount(cols[at], vals[at], width) / len(rows)
            far = rows[int((norm2[rows] - 2 * products(rows, c)).argmax())]
            to_far = norm2[rows] + norm2[far] - 2 * products(rows, dense_of(far))
            other = rows[int(to_far.argmax())]
            side = to_far - (norm2[rows] + norm2[other] - 2 * products(rows, dense_of(other)))
            near_far = side <= 0
            if not len(rows) / 8 <= near_far.sum() <= len(rows) * 7 / 8:
                near_far = np.zeros(len(rows), bool)
                near_far[np.argsort(side, kind="stable")[: len(rows) // 2]] = True
            order[a:b] = np.concatenate([rows[near_far], rows[~near_far]])
            cut = a + int(near_far.sum())
            left[node] = len(first)
            todo += [len(first), len(first) + 1]
            first += [a, cut]
            last += [cut, b]
            left += [-1, -1]
        return order, first, last, left

    def _balls(self) -> None:
        """Centroids as (term, node, value) by term, and a radius per node and band."""
        nodes = len(self.first)
        self.radius = np.zeros((nodes, BANDS))
        v = self.vals.astype(np.float64)
        at_term, at_node, value = [], [], []
        for i in range(nodes):
            a, b = self.ptr[self.first[i]], self.ptr[self.last[i]]
            n = self.last[i] - self.first[i]
            used, col = np.unique(self.cols[a:b], return_inverse=True)
            c = np.bincount(col, v[a:b], len(used)) / max(1, n)
            at_term.append(used)
            at_node.append(np.full(len(used), i))
            value.append(c)
            row = np.repeat(np.arange(n), np.diff(self.ptr[self.first[i]:self.last[i] + 1]))
            band = self.band[used]
            # |d - c|^2 = |c|^2 + sum over d's terms of (d - c)^2 - c^2, per band
            d2 = np.bincount(row * BANDS + band[col], (v[a:b] - c[col]) ** 2 - c[col] ** 2, n * BANDS).reshape(n, BANDS)
            c2 = np.bincount(band, c * c, BANDS)
            self.radius[i] = np.sqrt(np.maximum(0.0, d2 + c2).max(0, initial=0.0) + 1e-9 * c2) * (1 + 1e-9)
        at_term = np.concatenate(at_term)
        order = np.argsort(at_term, kind="stable")
        self.c_ptr = np.searchsorted(at_term[order], np.arange(self.width + 1))
        self.c_node, self.c_value = np.concatenate(at_node)[order], np.concatenate(value)[order]

    def bounds(self, cols: np.ndarray, q: np.ndarray) -> np.ndarray:
        """An upper bound of <q, d> for every node."""
        nodes = len(self.first)
        lens = self.c_ptr[cols + 1] - self.c_ptr[cols]
        at = np.repeat(self.c_ptr[cols] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        node, mine = self.c_node[at], np.repeat(q, lens)
        middle = np.bincount(node, mine * self.c_value[at], nodes)
        reach = np.sqrt(np.bincount(node * BANDS + np.repeat(self.band[cols], lens), mine * mine, nodes * BANDS).reshape(nodes, BANDS))
        return (middle + (reach * self.radius).sum(1)) * (1 + 1e-9) + 1.0

    def search(self, item: dict[bytes, int], k: int, least: int, leaves: int | None, opened: list[int] | None = None) -> list[tuple[int, int]]:
        """(score, doc_id) of the k best documents with a score of at least ``least`` (and above 0); at most ``leaves`` leaves are opened."""
        known = [(self.place[w], x) for w, x in item.items() if x > 0 and w in self.place]
        if not known or not len(self.ids):
            return []
        cols, q = np.array([c for c, _ in known]), np.array([x for _, x in known], np.int64)
        dense = np.zeros(self.width, np.int64)
        dense[cols] = q
        bound = self.bounds(cols, q.astype(np.float64))
        best: list[tuple[int, int]] = []
        heap = [(-bound[0], 0)]
        while heap and (leaves is None or leaves > 0):
            top, node = heapq.heappop(heap)
            least_now = max(least, 1, best[k - 1][0] if len(best) >= k else 0)
            if -top < least_now:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.left[node] + 1):
                    if bound[child] >= least_now:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.first[node], self.last[node]
            p = self.ptr[a:b + 1]
            total = np.append(0, np.cumsum(dense[self.cols[p[0]:p[-1]]] * self.vals[p[0]:p[-1]]))
            score = total[p[1:] - p[0]] - total[p[:-1] - p[0]]
            hit = np.flatnonzero(score >= least_now)
            best += zip(score[hit].tolist(), self.ids[a:b][hit].tolist(), strict=True)
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
            if leaves is not None:
                leaves -= 1
            if opened is not None:
                opened.append(node)
        return best


def document_weight(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def blocks_of(batches: Iterator[pa.RecordBatch], total: int, length: int, block_rows: int) -> Iterator[Block]:
    ids, words, values, entries = [], [], [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            for r in batch.slice(a, ROWS_AT_ONCE).to_pylist():
                m = 100 - 75 + 75 * r["n"] * total // length
                ids.append(r["doc_id"])
                words.append(r["terms"])
                values.append([document_weight(tf, m) for tf in r["tfs"]])
                entries += len(r["terms"])
                if len(ids) >= block_rows or entries >= BLOCK_ENTRIES:
                    yield Block(ids, words, values)
                    ids, words, values, entries = [], [], [], 0
    if ids:
        yield Block(ids, words, values)


def search_blocks(part, total: int, length: int, k: int, block_rows: int, leaves: int | None) -> Callable:
    """Vectors of a task -> (item, doc_id, score) of each of its blocks.

    part: list of (item, {term: weight}, least score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, total, length, block_rows):
            found = [(item, doc, score) for item, q, least in part.value for score, doc in block.search(q, k, least, leaves)]
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["item", "doc_id", "score"])
    return run


def best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parts_of(q: pd.DataFrame, least: dict[int, int]) -> list[tuple[int, dict[bytes, int], int]]:
    return [(int(item), dict(zip(map(bytes, g["term"]), map(int, g["q"]), strict=True)), least.get(int(item), 0)) for item, g in q.groupby("item", sort=True)]


def rank(docs: DataFrame, items: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, part_terms: int = PART_TERMS) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> (item_id, rank, doc_id, score)."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    asked = store(item_terms(items), "search-items")
    kind = items.schema["item_id"].dataType.simpleString()
    answer = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    distinct = store(asked.select("term").distinct(), "search-terms")
    n_terms = distinct.count()
    if not n_terms:
        return answer

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(term_keys(b.column(0).to_pylist()))], names=["key"])

    marks = spark.sparkContext.broadcast(marked(distinct.mapInArrow(keys, "key long"), n_terms))
    vectors = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count_terms(marks), "doc_id long, n long, terms array<binary>, tfs array<long>"), "search-vectors")
    total, length = vectors.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return answer
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    entries = asked.count()
    parts = max(1, -(-entries // part_terms))
    weighed = store(asked.join(df, "term").withColumn("q", F.col("times") * weight(F.lit(total), F.col("df")))
                    .withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts))).select("part", "item", "term", "q"), "search-weights")
    index = vectors.where("doc_id IS NOT NULL AND size(terms) > 0").select("doc_id", "n", "terms", "tfs")
    found = None
    for p in range(parts):
        # about part_terms rows: items are dealt by hash
        q = weighed.where(F.col("part") == p).toPandas()
        run = lambda least, leaves, q=q: index.mapInArrow(search_blocks(
            spark.sparkContext.broadcast(parts_of(q, least)), total, length, k, block_rows, leaves), "item long, doc_id long, score long")
        first = best_of(run({}, FIRST_LEAVES), k).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        least = {r["item"]: r["least"] for r in first.collect()}  # one number per item of the part
        some = run(least, None)
        found = some if found is None else found.unionByName(some)
    names = asked.select("item", "item_id").distinct()
    return (best_of(found, k).join(names, "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def op12_lexical_search(spark, sf_dir):
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL),
l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS total, sum(n)::BIGINT AS len FROM l),
w AS (
  SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM t, s GROUP BY term, total),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
q AS (SELECT item_id, term, count(*)::BIGINT * any_value(w) AS q FROM i JOIN w USING (term) GROUP BY item_id, term),
r AS (
  SELECT item_id, t.doc_id, sum(q * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // len))))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN l ON l.doc_id = t.doc_id, s GROUP BY item_id, t.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
