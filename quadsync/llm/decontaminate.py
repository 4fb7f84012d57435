"""Operator 9: benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of non-ASCII
bytes; case, punctuation and spacing do not matter.  Every span of a benchmark
item gives one hash per mask; a mask looks at some word positions of the span
and ignores the others, so a substituted word there is no loss.  Documents give
the same hashes; equal hashes give the diagonals (item, document, offset) to
verify.  On each diagonal the longest run is sought that begins and ends on equal
words, or is the whole item, and of which at least 4 of 5 words are equal; a
document is contaminated by an item when that run has at least ``min_words``
words, or is the whole item where that is shorter.

The masks lose no such run of ``MIN_WORDS`` words or more: a mask is two groups of
three words with one of ``GAPS`` words between them, and wherever a fifth of 12 to
23 words is substituted, two groups stay whole at one of these gaps (longer runs
hold such a part).  A shorter item is sought whole: with m words that may differ it
is cut into m + 2 blocks, and each two blocks are a mask.  A fifth of fewer than
five words is none, so such items are sought word for word.  Items of any length
count: one of a single word contaminates every document that holds the word.

The documents' hashes are not shuffled: a Bloom filter of the benchmark's
hashes, ``BLOOM_BITS`` bits whatever the tables, is broadcast, and only documents
with a hash in it go on, with their word hashes.  A filter that is too full for
a huge benchmark lets more documents through and loses none.

Cases: null and empty texts and items have no words and match nothing; equal
rows each are found; items without id are named null; several items may be
found in one document and one item several times (the best run is returned).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadsync.llm.shared import store, table
from quadsync.llm.text_arrays import LOWER_AZ, buffers, mix, pieces, span_hashes, word_spans
from quadsync.session import ship_package

#: words between the two groups of ``GROUP`` words that a mask looks at
GAPS = (0, 3, 6, 9, 12)
GROUP = 3
MIN_WORDS = 12
MISMATCH = -4
BLOOM_BITS = 1 << 24
BLOOM_HASHES = 3

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order)."""
    raw, offsets = buffers(col)
    for a, b in pieces(offsets):
        buf = LOWER_AZ[raw[offsets[a]:offsets[b]]]
        start, end, row = word_spans(buf, offsets[a:b + 1] - offsets[a], WORD_BYTES)
        h = span_hashes(buf, start, end)
        cut = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, h[cut[i]:cut[i + 1]]


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of all masks at all positions."""
    out_h, out_p = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(words) >= 2 * GROUP:
        group = np.full(len(words) - GROUP + 1, 0x9E3779B97F4A7C15, np.uint64)
        for k in range(GROUP):
            group = group * np.uint64(0xD6E8FEB86659FD93) + words[k: len(group) + k]
        group = mix(group)
        for j, gap in enumerate(GAPS):
            n = len(group) - GROUP - gap
            if n > 0:
                out_h.append(mix(group[:n] * np.uint64(2 * j + 3) + group[GROUP + gap:]))
                out_p.append(np.arange(n))
    return np.concatenate(out_h), np.concatenate(out_p)


@lru_cache(maxsize=MIN_WORDS)
def short_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks (word positions) of a whole item of n words, below MIN_WORDS: two clean blocks are left wherever a fifth of its words is substituted."""
    blocks = np.array_split(np.arange(n), n // 5 + 2)
    return tuple(tuple(int(k) for x in two for k in x) for two in combinations(blocks, 2))


def short_seeds(words: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of whole sequences of the given lengths (below MIN_WORDS) under their masks at every position."""
    out_h, out_p = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in lengths:
        if len(words) >= n:
            for j, mask in enumerate(short_masks(n)):
                h = np.zeros(len(words) - n + 1, np.uint64)
                for k in mask:
                    h += words[k: len(h) + k] * np.uint64(2 * k + 3)
                out_h.append(mix(h + np.uint64(n + MIN_WORDS * j)))
                out_p.append(np.arange(len(h)))
    return np.concatenate(out_h), np.concatenate(out_p)


def bloom_slots(h: np.ndarray) -> list[np.ndarray]:
    return [mix(h + np.uint64(j + 1)) & np.uint64(BLOOM_BITS - 1) for j in range(BLOOM_HASHES)]


def benchmark_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [w for _, w in word_hashes(b.column(1))]
        yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([w.tobytes() for w in words], pa.binary())],
                              names=["item_id", "n_words", "words"])


def benchmark_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for item, uid, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            words = np.frombuffer(blob, np.uint64)
            h, p = seeds(words) if n >= MIN_WORDS else short_seeds(words, (n,))
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(p), pa.array([item] * len(h), pa.int64()), pa.array([uid] * len(h), pa.int64()),
                                   pa.array([n] * len(h), pa.int64())], names=["hash", "item_pos", "item_id", "item_uid", "n_words"])


def bloom_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = np.unique(np.concatenate(bloom_slots(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
        yield pa.record_batch([pa.array((s >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (s & np.uint64(63))).view(np.int64))], names=["slot", "bits"])


def scan_documents(bloom, lengths: tuple[int, ...]) -> Callable:
    """Documents with a seed in the filter: (uid, doc_id, words, hashes, positions)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, uid = np.unpackbits(bloom.value.view(np.uint8), bitorder="little").view(bool), TaskContext.get().partitionId() << 33
        for b in batches:
            ids, rows = b.column(0), {k: [] for k in ("uid", "doc_id", "words", "hashes", "at")}
            for i, words in word_hashes(b.column(1)):
                h, p = seeds(words)
                if lengths:
                    h2, p2 = short_seeds(words, lengths)
                    h, p = np.concatenate([h, h2]), np.concatenate([p, p2])
                for slot in range(BLOOM_HASHES):
                    ok = bits[(mix(h + np.uint64(slot + 1)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)]
                    h, p = h[ok], p[ok]
                if len(h):
                    for k, v in zip(rows, (uid + i, ids[i].as_py(), words.tobytes(), h.view(np.int64).tolist(), p.tolist()), strict=True):
                        rows[k].append(v)
            uid += b.num_rows
            yield pa.record_batch([pa.array(rows["uid"], pa.int64()), pa.array(rows["doc_id"], pa.int64()), pa.array(rows["words"], pa.binary()),
                                   pa.array(rows["hashes"], pa.list_(pa.int64())), pa.array(rows["at"], pa.list_(pa.int64()))], names=list(rows))
    return run


def best_run(item: np.ndarray, doc: np.ndarray, offset: int) -> tuple[int, int, int]:
    """(words, equal words, start in the document) of the best run where item[i] lies on doc[i + offset]."""
    a = max(0, -offset)
    b = min(len(item), len(doc) - offset)
    if a >= b:
        return 0, 0, 0
    same = item[a:b] == doc[a + offset: b + offset]
    total = np.append(0, np.cumsum(np.where(same, 1, MISMATCH)))
    low = np.minimum.accumulate(total)
    gain = total - low
    end = int(np.flatnonzero(gain == gain.max())[-1])  # of equal runs the longest
    start = int(np.flatnonzero(total[:end + 1] == low[end])[0])
    return end - start, int(same[start:end].sum()), a + offset + start


def longest_run(item: np.ndarray, doc: np.ndarray, offset: int) -> tuple[int, int, int]:
    """(words, equal words, start in the document) of the longest run with 4 of 5 words equal where item[i] lies
    on doc[i + offset]; it begins and ends on equal words or is the whole item.  Of equally long ones the one
    with more equal words, then the first."""
    a = max(0, -offset)
    b = min(len(item), len(doc) - offset)
    if a >= b:
        return 0, 0, 0
    same = item[a:b] == doc[a + offset: b + offset]
    total = np.append(0, np.cumsum(np.where(same, 1, MISMATCH)))
    if b - a == len(item) and total[-1] >= 0:
        return b - a, int(same.sum()), a + offset
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0
    # for each last word the first start whose sum before it is not larger
    low = np.minimum.accumulate(total[at])
    first = np.searchsorted(-low, -total[at + 1])
    words, equal = at + 1 - at[first], np.arange(len(at)) + 1 - first
    best = int(np.argmax(words * (len(same) + 1) + equal))
    return int(words[best]), int(equal[best]), int(a + offset + at[first[best]])


def verify(min_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "doc_id", "item_id", "item_words", "run_words", "equal_words", "doc_start"]
        for b in batches:
            out = []
            for uid, doc_id, item_id, n, base, diagonal, item, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, equal, start = longest_run(np.frombuffer(item, np.uint64), np.frombuffer(part, np.uint64), diagonal - base)
                if words >= min(min_words, n):
                    out.append((uid, doc_id, item_id, n, words, equal, base + start))
            yield pa.record_batch([pa.array([r[j] for r in out], pa.int64()) for j in range(len(names))], names=names)
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, item_id,
    item_words, run_words, equal_words, doc_start), a row for each contaminated
    document row and item."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    items = store(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
                  .mapInArrow(benchmark_words, "item_id long, n_words long, words binary").where("n_words > 0")
                  .withColumn("item_uid", F.monotonically_increasing_id()).select("item_id", "item_uid", "n_words", "words"), "bench-items")
    marks = store(items.mapInArrow(benchmark_seeds, "hash long, item_pos long, item_id long, item_uid long, n_words long"), "bench-seeds")
    lengths = tuple(r[0] for r in items.where(F.col("n_words") < MIN_WORDS).select("n_words").distinct().collect())  # MIN_WORDS - 1 values at most
    filled = marks.select("hash").mapInArrow(bloom_words, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    bloom = np.zeros(BLOOM_BITS // 64, np.int64)
    got = filled.toPandas()  # BLOOM_BITS / 64 rows at most
    bloom[got["slot"].to_numpy()] = got["bits"].to_numpy()
    sent = spark.sparkContext.broadcast(bloom)
    hit = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                .mapInArrow(scan_documents(sent, lengths), "uid long, doc_id long, words binary, hashes array<long>, at array<long>"), "bench-hits")
    found = (hit.select("uid", F.explode(F.arrays_zip("hashes", "at")).alias("s")).select("uid", F.col("s.hashes").alias("hash"), F.col("s.at").alias("at"))
             .join(marks.select("hash", "item_pos", "item_uid", "n_words"), "hash")
             .select("uid", "item_uid", "n_words", (F.col("at") - F.col("item_pos")).alias("diagonal")).distinct())
    found = store(found, "bench-diagonals")
    start = F.greatest(F.lit(0), F.col("diagonal"))
    parts = (found.join(hit.select("uid", "doc_id", "words"), "uid")
             .select("uid", "doc_id", "item_uid", "diagonal", start.alias("base"),
                     F.substring(F.col("words"), (start * 8 + 1).cast("int"), ((F.col("diagonal") + F.col("n_words") - start) * 8).cast("int")).alias("part")))
    pairs = parts.join(items.select("item_uid", "item_id", "n_words", F.col("words").alias("item_words")), "item_uid")
    cols = "uid long, doc_id long, item_id long, item_words long, run_words long, equal_words long, doc_start long"
    runs = pairs.select("uid", "doc_id", "item_id", "n_words", "base", "diagonal", "item_words", "part").mapInArrow(verify(min_words), cols)
    best = F.max(F.struct("run_words", "equal_words", -F.col("doc_start"), "item_words"))
    return (runs.groupBy("uid", "doc_id", "item_id").agg(best.alias("b"))
            .select("doc_id", "item_id", F.col("b.item_words").alias("item_words"), F.col("b.run_words").alias("run_words"),
                    F.col("b.equal_words").alias("equal_words"), (-F.col("b.col3")).alias("doc_start")))


def op9_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
