"""Byte-level BPE, lexical search and whitening on small tables, against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quadsync.llm import byte_bpe, lexical_search, whitening

MORE = "lang string, block long, row string, ids string, n int, item long, x int"


def table_of(spark, rows, columns):
    """rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "en", 7, "r", "i", 1, 2, 3) for r in rows], f"{columns}, {MORE}")


# -- 11 -----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    pieces = ["the", " the", "  ", "\n\n", "'s", "'S", "don't", " 123", "4567", "é", "ß", " Ω", "漢字", "🙂", "👩‍👩‍👧", "\t", " ", "  ", "　", "…", "!?", " --", "\x1c", "\x00", "á", "x" * 300]
    out = ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(150)]
    return [None, "", " ", "   ", "\n", *out, out[0], "word " * 300_000, "y" * 200_000, " " * 50_000 + "z"]


def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_merges(ranks, word):
    """Ids of one pre-token by merging the pair of lowest rank, again and again."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def test_encode_equals_the_library_and_decode_gives_the_text_back(spark, ranks, texts):
    docs = table_of(spark, list(enumerate(texts)), "doc_id long, text string").repartition(3)
    enc = plain(ranks)
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_chars=5_000, shard_words=500)
    got = {r[0]: r[1] for r in coded.collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r[0]: bytes(r[1]) for r in byte_bpe.decode(coded, ranks, block_size=700).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_packed_numbers_come_back():
    x = np.array([0, 191, 192, 193, 14_527, 14_528, 14_529, 473_279, 473_280, 473_281, 1 << 31, (1 << 32) - 1, 5, 250] * 3)
    assert byte_bpe.unpack_numbers(byte_bpe.pack_numbers(x)).tolist() == x.tolist()
    assert byte_bpe.unpack_numbers(byte_bpe.pack_numbers(x[:0])).tolist() == []


def test_words_are_merged_by_rank(spark, ranks):
    words = ["lower", " lowest", " unbelievable", "zzqx", "ñandú", " 漢字"]
    got = byte_bpe.encode(spark.createDataFrame([(w, w) for w in words], "doc_id string, text string"), ranks, public_tokenizers.PATTERN)
    assert {r[0]: r[1] for r in got.collect()} == {w: by_merges(ranks, w.encode()) for w in words}


def test_round_trip_keeps_every_row(spark, ranks):
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (None, None), (2, "")]
    got = byte_bpe.round_trip(table_of(spark, rows, "doc_id long, text string"), ranks, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (0, 2), (1, 2), (1, 2), (2, 0)]
    empty = byte_bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), ranks, public_tokenizers.PATTERN)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_unknown_ids_are_refused(spark, ranks):
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [5, 50_256])], "doc_id long, ids array<int>"), ranks).collect()


# -- 12 -----------------------------------------------------------------------------------------------------------

def brute_search(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(split(t))) for i, t in docs]
    total = sum(1 for _, c in counted if c)
    length = sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        q = Counter(split(text))
        scores = []
        for i, c in counted:
            m = 100 - 75 + 75 * sum(c.values()) * total // length if length else 0
            s = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, n in q.items() if c[w])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, j + 1, i, -s) for j, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def searched(spark, docs, items, **how):
    got = lexical_search.rank(table_of(spark, docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **how)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def library():
    r = random.Random(11)
    words = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(r.choice([w, w.upper(), w + "_"]) for w in r.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    docs = [(i, text(r.randint(1, 60))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (7, text(5)), (None, docs[3][1]), (600, None), (601, ""), (602, "-- ?!"), (603, text(20_000)), (604, words[0] * 1000)]
    items = [(i, docs[i * 9][1]) for i in range(30)] + [(40, None), (41, ""), (42, "qqqqq"), (5, text(8)), (None, docs[3][1]), (43, f"{words[3]} " * 50)]
    return docs, items


def test_search_equals_brute_force(spark, library):
    docs, items = library
    want = brute_search(docs, items)
    assert len(want) > 250
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, block_rows=50, part_terms=40) == want


def test_search_of_empty_tables(spark, library):
    docs, items = library
    assert searched(spark, [], items) == [] == searched(spark, docs, []) == searched(spark, [(1, None)], items)


def test_bounds_hold_for_every_node_and_prune(library):
    r = np.random.default_rng(2)
    topics = [[f"t{t}w{i}".encode() for i in range(12)] for t in range(40)]
    words = [[w for w in topics[i % 40] if r.random() < 0.9] or [topics[i % 40][0]] for i in range(2000)]
    block = lexical_search.Block(list(range(2000)), words, [[int(r.integers(300_000, 400_000)) for _ in ws] for ws in words])
    opened_share = []
    for t in range(40):
        q = {w: int(r.integers(1000, 9000)) for w in topics[t][:6]} | {topics[(t + 1) % 40][0]: 500}
        cols = np.array([block.place[w] for w in q])
        values = np.array(list(q.values()), float)
        bound = block.bounds(cols, values)
        dense = np.zeros(block.width, np.int64)
        dense[cols] = list(q.values())
        products = dense[block.cols] * block.vals
        score = np.array([products[a:b].sum() for a, b in zip(block.ptr[:-1], block.ptr[1:], strict=True)])
        for node in range(len(bound)):
            assert bound[node] >= score[block.first[node]:block.last[node]].max()
        opened = []
        got = block.search(q, 10, 0, None, opened)
        best = sorted(zip((-score).tolist(), block.ids.tolist(), strict=True))[:10]
        assert got == [(-s, i) for s, i in best]
        opened_share.append(len(opened) / (block.left < 0).sum())
    assert np.mean(opened_share) < 0.3


# -- 13 -----------------------------------------------------------------------------------------------------------

def test_eigenpairs_with_clusters_and_without_rank():
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.standard_normal((24, 24)))
    for d in (np.linspace(1, 2, 24), np.r_[np.ones(20), 5, 5, 5, 5], np.r_[np.zeros(22), 1, 3], np.r_[np.linspace(0, 1, 22), 2, 2 + 1e-9], 1e-9 * np.arange(24.0)):
        v = (q * d) @ q.T
        v = (v + v.T) / 2
        got = whitening.leading_eigenpairs(v, 4)
        want = [e for e in sorted(d, reverse=True)[:4] if e > 0]
        assert np.allclose([e for e, _ in got], want, rtol=1e-12, atol=1e-13 * d.max())
        w = np.array([x for _, x in got])
        assert np.abs(w @ w.T - np.eye(len(got))).max() < 1e-12
        assert all(np.linalg.norm(v @ x - e * x) < 1e-12 * d.max() for e, x in got)
    assert whitening.leading_eigenpairs(np.zeros((3, 3)), 4) == []


def test_inertia_counts():
    r = np.random.default_rng(4)
    for n in (1, 2, 7, 30):
        a = r.standard_normal((n, n))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for t in (*r.standard_normal(5) * n, 0.0):
            assert whitening.above(a, t) == (e >= t).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_whitening_equals_the_plain_computation(spark):
    r = np.random.default_rng(9)
    v = r.standard_normal((300, 6)) @ r.standard_normal((6, 6)) * 0.2
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(50)]
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (None, v[1].tolist()), (3, v[3].tolist())]
    got = whitening.whiten(table_of(spark, rows, "vec_id long, embedding array<double>")).toPandas()
    x = np.floor(256 * v).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    e, w = np.linalg.eigh(np.cov(u.T.astype(float), bias=True))
    e, w = e[::-1][:4], w[:, ::-1][:, :4]
    z = (x - u.mean(0)) @ w / np.sqrt(e)
    assert len(got) == 4 * (300 + 52) and (got["n"] == n).all()
    some = got[got["vec_id"] < 300].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    m = some["whitened"].to_numpy().reshape(-1, 4)
    for j in range(4):
        assert min(np.abs(m[:, j] - z[:, j]).max(), np.abs(m[:, j] + z[:, j]).max()) < 1e-11
    assert some["deviation"].tolist() == np.repeat(((n * x - s) ** 2).sum(1), 4).tolist()
    assert np.allclose(some["explained"].to_numpy()[:4], e / np.trace(np.cov(u.T.astype(float), bias=True)), rtol=1e-10)
    assert 0 <= got["identity_error"].iloc[0] < 1e-9 and got["identity_error"].nunique() == 1


def test_whitening_of_few_distinct_and_very_large_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [5.0])], kind)).collect()
    assert [(r["vec_id"], r["component"]) for r in sorted(two)] == [(1, 1), (2, 1)]
    assert sorted(abs(r["whitened"]) for r in two) == pytest.approx([1.0, 1.0])
    large = whitening.whiten(spark.createDataFrame([(1, [1e17, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], kind)).collect()
    assert len(large) >= 3 and all(r["deviation"] is None for r in large if r["vec_id"] < 3)
    one = whitening.whiten(spark.createDataFrame([(i, [float(i)]) for i in range(5)], kind)).collect()
    assert len(one) == 5 and {r["explained"] for r in one} == {1.0}
