"""Operator 10: language identification by multinomial naive Bayes.

Features are hashed character n-grams (1 to 3) of the lower-cased text, where
every run of characters that are no letters is one space.  The model is fitted
on all labelled rows, so no language is lost however rare: n-gram counts per
language are summed on Spark, the log-probability matrix (languages x ``BUCKETS``, at most
``MAX_LANGS`` languages) is broadcast, and batches are scored in numpy: the rows
of the matrix that a text's n-grams name are summed.  The score is the posterior
probability of the best language.

Cases: a text that is null, empty or has no letter gets ``und`` with score 0; equal
scores go to the language that is smaller by code points; without any labelled row
every text gets ``und``; labels that are null are not learned from.  Only the id
(for the fold), the text and the label are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadsync.llm.shared import table
from quadsync.llm.text_arrays import buffers, pieces
from quadsync.session import ship_package

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: bytes of text whose n-grams and matrix rows (some 200 times as much) are held at a time
PIECE = 1 << 17
ALPHA = 0.1
MAX_LANGS = 2_000
UND = "und"


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code point -> its lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of rows of UTF-8; broken sequences become U+FFFD."""
    data = raw.tobytes()
    begins = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    text = data.decode("utf-8", "replace")
    if len(text) == begins[-1] and "�" not in text:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32), begins[offsets]
    rows = [data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    cp = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    return cp, np.append(0, np.cumsum([len(r) for r in rows]))


def ngrams(col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, bucket of each n-gram, its row, letters per row) for pieces of a column."""
    table_ = folded()
    raw, offsets = buffers(col)
    for a, b in pieces(offsets, PIECE):
        cp, off = code_points(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        c = table_[cp]
        row = np.repeat(np.arange(b - a), np.diff(off))
        letters = np.bincount(row[c != 32], minlength=b - a)
        keep = np.ones(len(c), bool)
        if len(c) > 1:
            keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])
        c, row = c[keep].astype(np.uint64), row[keep]
        out_b, out_r = [], []
        h = np.zeros(len(c), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1:] + np.uint64(n)
            if n in ORDERS:
                ok = row[: len(h)] == row[n - 1:]
                z = h[ok]
                z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out_b.append((z >> np.uint64(40)).astype(np.int64) % BUCKETS)
                out_r.append(row[: len(h)][ok])
        if out_b:
            yield a, b - a, np.concatenate(out_b), np.concatenate(out_r), letters
        else:
            yield a, b - a, np.zeros(0, np.int64), np.zeros(0, np.int64), letters


def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, bucket, n) sums of one task; bucket -1 counts the rows."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        langs = np.array(b.column(0).to_pylist(), object)
        for a, n, bucket, row, letters in ngrams(b.column(1)):
            mine = langs[a:a + n]
            for lang in set(mine):
                total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                is_lang = mine == lang
                total[:BUCKETS] += np.bincount(bucket[is_lang[row]], minlength=BUCKETS)
                total[BUCKETS] += int((is_lang & (letters > 0)).sum())
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at)), pa.array(total[at])], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled (doc_id, text, lang) -> (languages, matrix BUCKETS + 1 x languages; the last row holds the log priors)."""
    ship_package(labelled.sparkSession)
    named = labelled.where("lang IS NOT NULL").select("lang", "text")
    langs = sorted(r[0] for r in named.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages; the model is broadcast for that many at most")
    sums = named.mapInArrow(count_ngrams, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toPandas()  # MAX_LANGS * (BUCKETS + 1) rows at most, and far fewer n-grams occur
    langs = sorted(set(got["lang"]))  # without those that only have texts without a letter
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[got["bucket"].to_numpy(), got["lang"].map({x: j for j, x in enumerate(langs)}).to_numpy(dtype=np.int64)] = got["n"]
    rows = counts[BUCKETS]
    with np.errstate(divide="ignore"):
        logs = np.log(counts[:BUCKETS] + ALPHA) - np.log(counts[:BUCKETS].sum(0) + ALPHA * BUCKETS)
    return langs, np.vstack([logs, np.log((rows + 1) / (rows.sum() + len(langs)))])


def score_batches(langs: list[str], model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for b in batches:
            best, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            text = b.column(1) if b.num_columns > 1 else b.column(0).field("text")
            for a, n, bucket, row, letters in ngrams(text):
                total = np.tile(logs[BUCKETS], (n, 1))
                o = np.argsort(row, kind="stable")
                bucket, row = bucket[o], row[o]
                if len(row) and len(langs):
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    for j in range(0, len(langs), 8):
                        total[row[first], j:j + 8] += np.add.reduceat(logs[bucket, j:j + 8], first, axis=0)
                    top = total.argmax(1)
                    p = 1 / np.exp(total - total[np.arange(n), top][:, None]).sum(1)
                    some = letters > 0
                    best[a:a + n][some], score[a:a + n][some] = top[some], p[some]
            names = np.array([*langs, UND], object)
            yield pa.record_batch([b.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, labelled: DataFrame, carry: Column, carry_type: T.DataType) -> DataFrame:
    """docs with ``text`` -> (row, lang_pred, score); ``carry`` is what goes along as ``row``."""
    ship_package(docs.sparkSession)
    langs, logs = fit(labelled)
    model = docs.sparkSession.sparkContext.broadcast(logs)
    schema = T.StructType([T.StructField("row", carry_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    # a row that holds its text does not bring it twice
    rows = docs.select(carry.alias("row")) if isinstance(carry_type, T.StructType) and "text" in carry_type.names else docs.select(carry.alias("row"), "text")
    return rows.mapInArrow(score_batches(langs, model), schema)


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, docs.where(fold(F.col("doc_id")) != 1), F.col("doc_id").cast("long"), T.LongType())
    return out.select(F.col("row").alias("doc_id"), (fold(F.col("row")) == 1).alias("held_out"), "lang_pred", "score")
