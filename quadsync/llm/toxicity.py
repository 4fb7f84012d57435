"""Operator 2: toxicity, scored on text restored by a noisy-channel decoder.

1. A character trigram model is counted over all documents: letters a-z, one
   symbol for other letters, one for everything between words.
2. Suspicious tokens (letters mixed with digits and signs that stand for
   letters, single letters spaced out, letters repeated three times or more)
   become lattices: per place the letters that the channel may have written so,
   with their costs.  Viterbi decoding finds the likeliest letters under the
   trigram model; the restored words join the document's words.  A gap between
   spaced letters (three or more with gaps of one width) writes nothing or a word
   boundary, so the decoding also says where words end; as three letters say
   little of that, words up to ``NEAR_WORD`` letters join too whose boundaries cost
   at most ``MARGIN`` more.  Tokens of any length are decoded: a place costs the
   same wherever it stands.
3. Words and their first letters are hashed features.  On a bounded sample of
   the labelled rows of the learning folds (``TRAIN_ROWS``, one of near copies) those
   that speak for label 1 beyond chance are weighted, and a logistic regression on a document's
   largest weight, sum of weights and number of hits gives the score.

Labels, language, source and id are never inputs of a score; the id only selects
the fold and the sample.

Cases: null and empty texts score as documents without any hit; equal texts get
equal scores; labels that are null or without document are not learned from, of
several labels of an id the largest counts; without labels of both kinds every
score is the share of label 1 (0 without any label).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadsync.llm.mixing import hash_unit
from quadsync.llm.shared import store, table
from quadsync.llm.text_arrays import buffers, folded, pieces, shingle_sets, span_hashes, word_spans
from quadsync.session import ship_package

TRAIN_ROWS = 10_000
BUCKETS = 1 << 32
FILTER = 1 << 20
PREFIXES = (4, 5)
MIN_Z = 3.0
MIN_DOCS = 5
THRESHOLD = 0.3
#: longer tokens are decoded each time instead of being kept
KEPT = 64
SYMBOLS = 28

#: byte -> a-z: 1 to 26 (either case), bytes of other letters: 27, anything else: 0
LETTER = np.zeros(256, np.uint8)
LETTER[65:91] = LETTER[97:123] = np.arange(1, 27)
LETTER[128:] = 27
#: fixed values: signs and the letters that they are written for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": ""}
SIGN_COST, SAME_COST, DROP_COST = 0.5, 0.0, 1.5
MARGIN, NEAR_WORD = 6.0, 24
IS_SIGN = np.zeros(256, bool)
IS_SIGN[[ord(c) for c in LEET]] = True
TOKEN = (LETTER > 0) | IS_SIGN
IS_GAP = np.zeros(256, bool)
IS_GAP[list(b" .-_*,/\\")] = True
#: stands in a token for a gap between spaced letters
GAP = " "
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> (gram, n) sums of one task."""
    total = np.zeros(SYMBOLS ** 3, np.int64)
    for b in batches:
        raw, offsets = buffers(b.column(0))
        for a, e in pieces(offsets):
            sym = LETTER[raw[offsets[a]:offsets[e]]].astype(np.int32)
            if len(sym) < 3:
                continue
            gram = (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]
            ok = np.ones(len(gram), bool)
            starts = (offsets[a + 1:e] - offsets[a])
            for back in (1, 2):
                at = starts - back
                ok[at[(at >= 0) & (at < len(gram))]] = False
            total += np.bincount(gram[ok], minlength=SYMBOLS ** 3)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative logs) of the third symbol after two, SYMBOLS**3 values, counted over all documents."""
    got = docs.select("text").mapInArrow(count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # SYMBOLS**3 rows at most
    n = np.zeros(SYMBOLS ** 3)
    n[got["gram"].to_numpy(dtype=np.int64)] = got["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = n.sum(0), n.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return -np.log((n + 5 * p2) / (n.sum(2, keepdims=True) + 5))


def decode(places: list[list[tuple[int, float]]], cost: np.ndarray) -> list[int]:
    """The cheapest symbols for a lattice; a place's symbol -1 writes nothing."""
    best = {(0, 0): (0.0, ())}
    for place in places:
        step: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (x, y), (c, path) in best.items():
            for sym, channel in place:
                to, now = ((x, y), c + channel) if sym < 0 else ((y, sym), c + channel + cost[x, y, sym])
                if to not in step or now < step[to][0]:
                    step[to] = (now, path if sym < 0 else (path, sym))
        best = step
    end = min(best.items(), key=lambda kv: (kv[1][0] + cost[kv[0][0], kv[0][1], 0], kv[0]))[1][1]
    out: list[int] = []
    while end:
        end, sym = end
        out.append(sym)
    return out[::-1]


def lattice(token: str) -> list[list[tuple[int, float]]]:
    """Places of a token: a letter writes itself, a sign one of its letters; in a
    run of equal letters those behind the first may write nothing; a gap writes
    nothing or a word boundary."""
    places: list[list[tuple[int, float]]] = []
    before = ""
    for ch in token:
        if ch == GAP:
            places.append([(-1, SAME_COST), (0, SAME_COST)])
            continue
        s = int(LETTER[ord(ch)]) if ord(ch) < 128 else 27
        if s:
            options = [(s, SAME_COST)]
            if ch == before:
                options.append((-1, SAME_COST))
        else:
            options = [(int(LETTER[ord(x)]), SIGN_COST) for x in LEET.get(ch, "")] + [(-1, DROP_COST)]
        places.append(options)
        before = ch
    return places


def near_words(letters: list[int], cost: np.ndarray) -> list[str]:
    """Words of 3 to NEAR_WORD of the letters with whose boundaries the cheapest
    reading costs at most MARGIN more than the cheapest of all."""
    n = len(letters)
    if n < 3:
        return []
    a = np.array(letters)
    first = cost[0, a[:-1], a[1:]]  # second letter of a word
    inner = np.concatenate([[0.0, 0.0], cost[a[:-2], a[1:-1], a[2:]]])  # its third and later ones
    end = np.concatenate([[0.0], cost[a[:-1], a[1:], 0]])  # boundary after a longer word
    end_one = cost[0, a, 0]  # after a word of one letter
    begin = np.concatenate([[cost[0, 0, a[0]]], cost[a[:-1], 0, a[1:]]])  # first letter after a boundary
    # cheapest cost up to a letter that begins a word (new) or goes on in one (on)
    new, on = np.full(n, np.inf), np.full(n, np.inf)
    new[0] = begin[0]
    for i in range(1, n):
        on[i] = min(on[i - 1] + inner[i], new[i - 1] + first[i - 1])
        new[i] = min(on[i - 1] + end[i - 1], new[i - 1] + end_one[i - 1]) + begin[i]
    best = min(on[-1] + end[-1], new[-1] + end_one[-1])
    # cheapest cost behind a boundary before letter i, and behind letter i that goes on in a word
    rest, going = np.zeros(n + 1), end[n - 1]
    rest[n - 1] = begin[n - 1] + end_one[n - 1]
    for i in range(n - 2, -1, -1):
        rest[i] = begin[i] + min(first[i] + going, end_one[i] + rest[i + 1])
        going = min(inner[i + 1] + going, end[i] + rest[i + 1])
    total = np.cumsum(inner)
    left, right = new[:-1] + first - total[1:], total + end + rest[1:]
    text = "".join(chr(96 + s) for s in letters)
    return [text[i:i + size] for size in range(3, min(n, NEAR_WORD) + 1)
            for i in np.flatnonzero(left[:n - size + 1] + right[size - 1:] <= best + MARGIN).tolist()]


class Decoder:
    def __init__(self, cost: np.ndarray):
        self.cost = cost
        self.known = lru_cache(maxsize=100_000)(self._restore)

    def restore(self, token: str) -> tuple[str, ...]:
        """Restored words of a suspicious token; of a letter repeated three times or more two are left."""
        token = STRETCHED.sub(r"\1\1", token)
        return self.known(token) if len(token) <= KEPT else self._restore(token)

    def _restore(self, token: str) -> tuple[str, ...]:
        """Restored words of a suspicious token: the decoding, and for repeated
        letters the one in which every run is a single letter."""
        out: list[str] = []
        symbols = [s for s in decode(lattice(token), self.cost) if s <= 26]
        words = "".join(chr(96 + s) if s else GAP for s in symbols).split(GAP)
        if GAP in token:
            words += near_words([s for s in symbols if s], self.cost)
        for letters in words:
            single = "".join(ch for i, ch in enumerate(letters) if i == 0 or ch != letters[i - 1])
            out += [w for w in (letters, single) if len(w) > 2]
        return tuple(dict.fromkeys(out))


def suspicious(buf: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> list[tuple[int, str]]:
    """(row, token) of the tokens to restore; start, end, row: the words of letters."""
    out: list[tuple[int, str]] = []
    text = buf.tobytes()
    # letters mixed with signs; signs at the end that are no digits are left out
    is_letter = LETTER[buf] > 0
    sign = IS_SIGN[buf]
    s, e, r = word_spans(buf, off, TOKEN)
    if sign.any() and len(s):
        strong = is_letter | (buf == 64) | ((buf >= 48) & (buf <= 57))
        last = np.maximum.reduceat(np.where(strong, np.arange(len(buf)), -1), s) + 1
        n_sign, n_letter = np.append(0, np.cumsum(sign)), np.append(0, np.cumsum(is_letter))
        last = np.minimum(np.maximum(last, s), e)
        mixed = (n_sign[last] > n_sign[s]) & (n_letter[last] > n_letter[s] + 1) & (last - s >= 3)
        for j in np.flatnonzero(mixed):
            out.append((int(r[j]), text[s[j]:last[j]].decode("utf-8", "replace")))
    # one letter repeated three times or more
    if len(buf) > 2:
        same = is_letter[2:] & (buf[2:] == buf[1:-1]) & (buf[2:] == buf[:-2])
        if same.any():
            for j in np.unique(np.searchsorted(start, np.flatnonzero(same), "right") - 1):
                if 0 <= j and end[j] - start[j] >= 3:
                    out.append((int(row[j]), text[start[j]:end[j]].decode("utf-8", "replace")))
    # single letters or signs, gaps of one width
    one = np.flatnonzero(e - s == 1)
    if len(one) > 2:
        width = s[one[1:]] - s[one[:-1]]
        n_other = np.append(0, np.cumsum(~IS_GAP[buf] & ~TOKEN[buf]))
        width[(one[1:] != one[:-1] + 1) | (r[one[1:]] != r[one[:-1]]) | (n_other[s[one[1:]]] > n_other[s[one[:-1]]])] = 0
        first = np.flatnonzero(np.append(True, width[1:] != width[:-1]))
        size = np.diff(np.append(first, len(width)))
        for a, n in zip(first[(size > 1) & (width[first] > 0)], size[(size > 1) & (width[first] > 0)], strict=True):
            token = "".join(chr(text[p]) for p in s[one[a:a + n + 1]] if text[p] < 128)
            if sum(ch.isalpha() for ch in token) >= 2:
                out.append((int(r[one[a]]), GAP.join(STRETCHED.sub(r"\1\1", token))))
    return out


def feature_buckets(words: list[str]) -> np.ndarray:
    """Features of restored words, as ``features`` gives them for words of the text."""
    raw = "".join(words).encode()
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    return buckets_of(np.frombuffer(raw, np.uint8), end - size, end)[0]


def buckets_of(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, number of the word) for words and their first letters."""
    starts, ends, who, salt = [start], [end], [np.arange(len(start))], [np.zeros(len(start), np.uint64)]
    for n in PREFIXES:
        long = np.flatnonzero(end - start > n)
        starts.append(start[long])
        ends.append(start[long] + n)
        who.append(long)
        salt.append(np.full(len(long), n, np.uint64))
    h = span_hashes(buf, np.concatenate(starts), np.concatenate(ends)) + np.concatenate(salt)
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(who)


def features(col, decoder: Decoder, some: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, features, their rows from it), each once per row; with ``some``
    only those whose low bits are marked there."""
    raw, offsets = buffers(col)
    for a, b in pieces(offsets, 1 << 19):
        buf = folded(raw[offsets[a]:offsets[b]])
        off = offsets[a:b + 1] - offsets[a]
        start, end, row = word_spans(buf, off, LETTER > 0)
        bucket, word = buckets_of(buf, start, end)
        if some is not None:
            ok = some[bucket % FILTER]
            bucket, word = bucket[ok], word[ok]
        key = [row[word] * BUCKETS + bucket]
        for r, token in suspicious(buf, off, start, end, row):
            words = decoder.restore(token)
            if words:
                key.append(r * BUCKETS + feature_buckets(list(words)))
        key = np.unique(np.concatenate(key))
        yield a, key % BUCKETS, key // BUCKETS


def with_least_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) with ``near``, the least hash of the text's four-word shingles: near copies mostly share it."""
    for b in batches:
        near = np.zeros(b.num_rows, np.uint64)
        for i, s in shingle_sets(b.column(2), 4):
            near[i] = s[0] if len(s) else 0
        yield pa.record_batch([*b.columns, pa.array(near.view(np.int64))], names=["doc_id", "toxic", "text", "near"])


def count_features(cost) -> Callable:
    """(toxic, text) -> (feature, n0, n1) sums of one task; feature -1 counts the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, rows = Decoder(cost.value), np.zeros(2, np.int64)
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows += np.bincount(y, minlength=2)
            seen = [(f, y[a + r]) for a, f, r in features(b.column(1), decoder)]
            if seen:
                f, at = np.unique(np.concatenate([x[0] for x in seen]), return_inverse=True)
                n1 = np.bincount(at, weights=np.concatenate([x[1] for x in seen]), minlength=len(f)).astype(np.int64)
                yield pa.record_batch([pa.array(f), pa.array(np.bincount(at, minlength=len(f)) - n1), pa.array(n1)], names=["feature", "n0", "n1"])
        yield pa.record_batch([pa.array([-1], pa.int64()), pa.array(rows[:1]), pa.array(rows[1:])], names=["feature", "n0", "n1"])
    return run


class Weights:
    """Sorted features with their weights, and marks of their low bits."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray):
        o = np.argsort(feature)
        self.feature, self.weight = np.append(feature[o], BUCKETS), np.append(weight[o], 0.0)
        self.some = np.zeros(FILTER, bool)
        self.some[feature % FILTER] = True


def hits(col, decoder: Decoder, w: Weights) -> np.ndarray:
    """(largest weight, log of the sum of weights, log of the number of hits) per row."""
    out = np.zeros((len(col), 3))
    for a, f, r in features(col, decoder, w.some):
        at = np.searchsorted(w.feature, f)
        ok = w.feature[at] == f
        if ok.any():
            value, r = w.weight[at[ok]], a + r[ok]
            np.maximum.at(out[:, 0], r, value)
            np.add.at(out[:, 1], r, value)
            np.add.at(out[:, 2], r, 1)
    out[:, 1:] = np.log1p(out[:, 1:])
    return out


def train_hits(cost, model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, w = Decoder(cost.value), Weights(*model.value)
        for b in batches:
            x = hits(b.column(1), decoder, w)
            yield pa.record_batch([b.column(0), *(pa.array(x[:, j]) for j in range(3))], names=["toxic", "x0", "x1", "x2"])
    return run


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the intercept comes first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_batches(cost, model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (feature, weight, beta), decoder = model.value, Decoder(cost.value)
        w = Weights(feature, weight)
        for b in batches:
            z = beta[0] + hits(b.column(1), decoder, w) @ beta[1:]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) to learn from -> (doc_id, score)."""
    ship_package(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cost = sc.broadcast(language_model(docs))
    lab = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("of"))
           .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    there = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    feature, weight, beta = np.zeros(0, np.int64), np.zeros(0), np.zeros(4)
    beta[0] = log(there.get(1, 0) / there[0]) if there.get(0) and there.get(1) else 30.0 if there.get(1) else -30.0
    if there.get(0) and there.get(1):
        share = {v: min(1.0, train_rows / 2 / there[v]) for v in (0, 1)}
        chosen = hash_unit("toxicity-sample", F.col("of")) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
        sample = lab.where(chosen)  # about train_rows small rows at most, so they may be broadcast
        # copies would make the rare words of one text look like evidence: one of them learns
        rows = (docs.join(F.broadcast(sample), F.col("doc_id") == F.col("of")).select("doc_id", "toxic", "text")
                .mapInArrow(with_least_shingle, "doc_id long, toxic int, text string, near long"))
        train = store(rows.groupBy("near").agg(F.min(F.struct("doc_id", "toxic", "text")).alias("x")).select("x.toxic", "x.text"), "toxicity-sample")
        got = train.mapInArrow(count_features(cost), "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(f"n1 >= {MIN_DOCS} OR feature < 0")
        got = got.toPandas()  # features of MIN_DOCS sampled rows at least
        all0, all1 = got.loc[got["feature"] < 0, ["n0", "n1"]].iloc[0]
        got = got[got["feature"] >= 0]
        n0, n1 = got["n0"].to_numpy(float), got["n1"].to_numpy(float)
        odds = np.log((n1 + 0.5) / (all1 - n1 + 0.5)) - np.log((n0 + 0.5) / (all0 - n0 + 0.5))
        z = odds / np.sqrt(1 / (n1 + 0.5) + 1 / (all1 - n1 + 0.5) + 1 / (n0 + 0.5) + 1 / (all0 - n0 + 0.5))
        good = (z > MIN_Z) & (odds > 1.0)
        feature, weight = got["feature"].to_numpy(dtype=np.int64)[good], odds[good]
        x = train.mapInArrow(train_hits(cost, sc.broadcast((feature, weight))), "toxic int, x0 double, x1 double, x2 double").toPandas().sort_values(["toxic", "x0", "x1", "x2"])  # the sample's rows
        y = x["toxic"].to_numpy(float)
        beta = logistic(x[["x0", "x1", "x2"]].to_numpy(), y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return docs.mapInArrow(score_batches(cost, sc.broadcast((feature, weight, beta))), "doc_id long, score double")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def op2_toxicity(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id")) != 2)
    out = toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
