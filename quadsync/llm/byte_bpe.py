"""Operator 11: byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Texts are split by the tokenizer's pattern.  A task writes its documents in
   blocks of about ``BLOCK_CHARS`` characters: the distinct words of the block by
   falling frequency, and the documents as numbers of those words, in their order.
2. The words of all blocks are dealt by their hash to shards.  A shard encodes
   each distinct word once and answers every block that holds it.
3. The answers go back to their block.  The distinct token ids of a block are
   joined with the token-byte table (one row per token of the vocabulary, so
   bounded) and come along.
4. A block puts its documents' ids together by the numbers' positions, and the
   bytes by the ids.

Blocks and answers are packed integers, so that what is shuffled stays below the
text itself.  A shard reads its rows one by one and keeps only its distinct words.

Cases: a null text is an empty one and has no ids; rows are kept as they are,
also those with equal or null ids; texts and words of any length are encoded
whole (long texts are cut only where a space follows another character, where
every match of the pattern ends); an empty table gives an empty result; only the
id and the text are read.  Ids outside of the vocabulary make ``decode`` fail.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadsync.llm.shared import store, table
from quadsync.session import ship_package

BLOCK_CHARS = 1 << 25
PIECE_CHARS = 1 << 20
#: (block, word) pairs of a shard
SHARD_WORDS = 1 << 20
#: words that an answer holds on average, at least
LEAST_WORDS = 64
ROWS_AT_ONCE = 256


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 text and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(blob, asbytes=True)


def unpack(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def pack_ints(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32; equal bytes of all numbers lie together."""
    return pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


#: first bytes from these on are followed by 1, 2 and 4 more
TWO, THREE, FIVE = 192, 248, 255
FROM_THREE = TWO + (THREE - TWO) * 256
FROM_FIVE = FROM_THREE + (FIVE - THREE) * 65536


def pack_numbers(x: np.ndarray) -> list[bytes]:
    """Numbers that are mostly small, in 1, 2, 3 or 5 bytes; first bytes and further bytes lie apart."""
    two, three, five = (x >= TWO) & (x < FROM_THREE), (x >= FROM_THREE) & (x < FROM_FIVE), x >= FROM_FIVE
    a, b, c = x[two] - TWO, x[three] - FROM_THREE, x[five]
    first = x.astype(np.uint8)
    first[two], first[three], first[five] = TWO + (a >> 8), THREE + (b >> 16), FIVE
    return [pack(p.tobytes()) for p in (first, a.astype(np.uint8), (b >> 8).astype(np.uint8), b.astype(np.uint8))] + [pack_ints(c)]


def unpack_numbers(blobs: list[bytes]) -> np.ndarray:
    first, low2, mid3, low3 = (np.frombuffer(unpack(p), np.uint8).astype(np.int64) for p in blobs[:4])
    out = first.copy()
    two, three, five = (first >= TWO) & (first < THREE), (first >= THREE) & (first < FIVE), first == FIVE
    out[two] = TWO + ((first[two] - TWO) << 8) + low2
    out[three] = FROM_THREE + ((first[three] - THREE) << 16) + (mid3 << 8) + low3
    out[five] = unpack_ints(blobs[4])
    return out


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return pack_ints(np.fromiter(map(len, words), np.int64, len(words))), pack(b"".join(words))


def unpack_words(lens: bytes, data: bytes) -> list[bytes]:
    at = [0, *np.cumsum(unpack_ints(lens)).tolist()]
    data = unpack(data)
    return [data[a:b] for a, b in itertools.pairwise(at)]


def ragged(starts: np.ndarray, lens: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the values of the lists ``which``, one list after the other."""
    n = lens[which]
    total = np.cumsum(n)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts[which] - (total - n), n)


def words_of(text: str, find: Callable[[str], list[str]], space: regex.Pattern) -> Iterator[list[str]]:
    """Matches of the pattern, in runs of about ``PIECE_CHARS`` characters."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = space.search(text, at + PIECE_CHARS)
        if cut is None:
            break
        yield find(text[at:cut.start() + 1])
        at = cut.start() + 1
    yield find(text[at:] if at else text)


class Block:
    """Documents as numbers of their distinct words (or token ids)."""

    def __init__(self, number: int):
        self.number, self.rows, self.counts, self.codes, self.size = number, [], [], array("I"), 0
        self.numbers: dict = defaultdict()
        self.numbers.default_factory = self.numbers.__len__

    def add(self, row, runs: Iterator[list], size: int) -> None:
        before = len(self.codes)
        for run in runs:
            self.codes.extend(map(self.numbers.__getitem__, run))
        self.rows.append(row)
        self.counts.append(len(self.codes) - before)
        self.size += size + 1

    def packed(self) -> tuple[list, list[bytes]]:
        """(distinct words by falling frequency, the documents' numbers)."""
        codes = np.frombuffer(self.codes, np.uint32).astype(np.int64) if self.codes else np.zeros(0, np.int64)
        order = np.argsort(-np.bincount(codes, minlength=len(self.numbers)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = list(self.numbers)
        return [words[i] for i in order.tolist()], pack_numbers(place[codes])


def in_blocks(batches: Iterator[pa.RecordBatch], block_size: int, runs_of: Callable) -> Iterator[Block]:
    """Blocks of one task; their numbers are the same when the task is run again."""
    first = TaskContext.get().partitionId() << 32
    block = Block(first)
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(a, ROWS_AT_ONCE)
            for row, value in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                block.add(row, runs_of(value or ()), len(value or ()))
                if block.size >= block_size:
                    yield block
                    block = Block(block.number + 1)
    if block.rows:
        yield block


def split_texts(pattern: str, row_type: pa.DataType, block_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, space = regex.compile(pattern).findall, regex.compile(r"\S(?=\s)")
        for b in in_blocks(batches, block_chars, lambda text: words_of(text or "", find, space)):
            words, codes = b.packed()
            lens, data = pack_words([w.encode() for w in words])
            yield pa.record_batch([pa.array([b.number]), pa.array([b.rows], pa.list_(row_type)), pa.array([b.counts], pa.list_(pa.int64())),
                                   pa.array([codes], pa.list_(pa.binary())), pa.array([len(words)], pa.int64()), pa.array([lens], pa.binary()), pa.array([data], pa.binary())],
                                  names=["block", "rows", "counts", "codes", "n_words", "lens", "words"])
    return run


def deal_words(shards: int) -> Callable:
    """(block, lens, words) -> one row for each shard that holds words of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = unpack_words(r["lens"], r["words"])
                to = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards
                order = np.argsort(to, kind="stable")
                ends = np.flatnonzero(np.append(to[order][1:] != to[order][:-1], True)) + 1 if len(order) else []
                a = 0
                for b in ends:
                    mine = order[a:b]
                    lens, data = pack_words([words[i] for i in mine.tolist()])
                    yield pa.record_batch([pa.array([int(to[mine[0]])]), pa.array([r["block"]]), pa.array([pack_ints(mine)], pa.binary()), pa.array([lens], pa.binary()), pa.array([data], pa.binary())],
                                          names=["shard", "block", "numbers", "lens", "words"])
                    a = b
    return run


_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(name: str, ranks) -> tiktoken.Encoding:
    """The worker's encoder of the vocabulary with this digest."""
    if name not in _encoders:
        # the pattern isn't used: words come split, and are encoded as single pieces
        _encoders[name] = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks.value, special_tokens={})
    return _encoders[name]


def encode_words(name: str, ranks) -> Callable:
    """All rows of a shard -> per row the ids of its words; each distinct word is encoded once."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, ranks)._encode_single_piece
        known: dict[bytes, array] = {}
        for batch in batches:
            for r in batch.to_pylist():
                lens, ids = array("I"), array("I")
                for w in unpack_words(r["lens"], r["words"]):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = array("I", encode(w))
                    lens.append(len(got))
                    ids.extend(got)
                ids = np.frombuffer(ids, np.uint32)
                yield pa.record_batch([pa.array([r["block"]]), pa.array([r["numbers"]], pa.binary()), pa.array([pack_ints(np.frombuffer(lens, np.uint32))], pa.binary()),
                                       pa.array([pack_ints(ids)], pa.binary()), pa.array([np.unique(ids).tolist()], pa.list_(pa.int32()))],
                                      names=["block", "numbers", "lens", "ids", "tokens"])
    return run


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """The token-byte table: one row per token."""
    rows = pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "token_bytes": pa.array(list(ranks), pa.binary())})
    return spark.createDataFrame(rows)


def joined_tokens(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, token) -> with the bytes; the table has as many rows as the vocabulary, so it is broadcast."""
    return tokens.distinct().join(F.broadcast(token_table(tokens.sparkSession, ranks)), "token", "left").select("block", "token", "token_bytes")


def row_types(docs: DataFrame) -> tuple[T.DataType, pa.DataType]:
    return docs.schema["row"].dataType, docs.select("row").limit(0).toArrow().schema.field(0).type


def encoded_blocks(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_chars: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """docs (row, text) -> (block, rows, counts, codes) and (block, numbers, lens, ids, tokens)."""
    ship_package(docs.sparkSession)
    row, row_arrow = row_types(docs)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(row)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("codes", T.ArrayType(T.BinaryType())),
                           T.StructField("n_words", T.LongType()), T.StructField("lens", T.BinaryType()), T.StructField("words", T.BinaryType())])
    blocks = store(docs.select("row", "text").mapInArrow(split_texts(pattern, row_arrow, block_chars), schema), "bpe-blocks")
    n_blocks, n_words = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    shards = max(1, -(-n_words // max(shard_words, LEAST_WORDS * n_blocks)))
    dealt = blocks.select("block", "lens", "words").mapInArrow(deal_words(shards), "shard long, block long, numbers binary, lens binary, words binary")
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    encode = encode_words(name, docs.sparkSession.sparkContext.broadcast(ranks))
    answers = store(dealt.groupBy("shard").applyInArrow(encode, "block long, numbers binary, lens binary, ids binary, tokens array<int>"), "bpe-answers")
    return blocks.select("block", "rows", "counts", "codes"), answers


def documents_of(blocks: pa.Table, answers: pa.Table) -> Iterator[tuple[object, np.ndarray]]:
    """(row, ids) of the documents of one block."""
    parts = [a for a in answers.select(["numbers", "lens", "ids"]).to_pylist() if a["numbers"] is not None]
    empty = [np.zeros(0, np.int64)]
    numbers = np.concatenate([unpack_ints(a["numbers"]) for a in parts] or empty)
    lens = np.concatenate([unpack_ints(a["lens"]) for a in parts] or empty)
    ids = np.concatenate([unpack_ints(a["ids"]) for a in parts] or empty)
    starts = np.empty(len(numbers), np.int64)
    sizes = np.empty(len(numbers), np.int64)
    starts[numbers], sizes[numbers] = np.cumsum(lens) - lens, lens
    for b in blocks.to_pylist():
        codes, at = unpack_numbers(b["codes"]), 0
        for row, n in zip(b["rows"], b["counts"], strict=True):
            yield row, ids[ragged(starts, sizes, codes[at:at + n])]
            at += n


def in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 22) -> pa.Table:
    """The rows as one table, built in batches."""
    out, cols, size = [], [[] for _ in schema], 0
    for r in rows:
        for c, v in zip(cols, r, strict=True):
            c.append(v)
            size += len(v) if hasattr(v, "__len__") else 1
        if size >= most:
            out.append(pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema))
            cols, size = [[] for _ in schema], 0
    out.append(pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema))
    return pa.Table.from_batches(out, schema)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("row"), F.col(f"`{text_col}`").alias("text"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: id, ``ids array<int>``."""
    some = texts_of(docs, id_col, text_col)
    row, row_arrow = row_types(some)
    blocks, answers = encoded_blocks(some, ranks, pattern, block_chars, shard_words)
    schema = pa.schema([(id_col, row_arrow), ("ids", pa.list_(pa.int32()))])

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        return in_batches(((r, ids.astype(np.int32)) for r, ids in documents_of(left, right)), schema)

    out = T.StructType([T.StructField(id_col, row), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return blocks.groupBy("block").cogroup(answers.drop("tokens").groupBy("block")).applyInArrow(put_together, out)


def split_ids(row_type: pa.DataType, block_size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches, block_size, lambda ids: iter([list(ids or ())])):
            tokens, codes = b.packed()
            yield pa.record_batch([pa.array([b.number]), pa.array([b.rows], pa.list_(row_type)), pa.array([b.counts], pa.list_(pa.int64())), pa.array([codes], pa.list_(pa.binary())), pa.array([tokens], pa.list_(pa.int32()))],
                                  names=["block", "rows", "counts", "codes", "tokens"])
    return run


def bytes_of(tokens: pa.Table) -> dict[int, bytes]:
    got = {t: b for t, b in zip(tokens["token"].to_pylist(), tokens["token_bytes"].to_pylist(), strict=True) if t is not None}
    if None in got.values():
        raise ValueError("a token id is not in the vocabulary")
    return got


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids", block_size: int = BLOCK_CHARS // 4) -> DataFrame:
    """One row per row: id, ``decoded binary``; the distinct ids of a block of rows are joined with the token-byte table."""
    ship_package(encoded.sparkSession)
    some = encoded.select(F.col(f"`{id_col}`").alias("row"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    row, row_arrow = row_types(some)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(row)), T.StructField("counts", T.ArrayType(T.LongType())),
                           T.StructField("codes", T.ArrayType(T.BinaryType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    blocks = store(some.mapInArrow(split_ids(row_arrow, block_size), schema), "bpe-ids")
    numbered = blocks.select(F.col("block").alias("of"), F.posexplode("tokens").alias("number", "token"))
    got = numbered.join(F.broadcast(token_table(encoded.sparkSession, ranks)), "token", "left").select("of", "number", "token", "token_bytes")
    out_schema = pa.schema([(id_col, row_arrow), ("decoded", pa.binary())])

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        known = bytes_of(right)
        by_number = dict(zip(right["number"].to_pylist(), right["token"].to_pylist(), strict=True))
        words = [known[by_number[i]] for i in range(len(by_number))]

        def rows() -> Iterator[tuple]:
            for b in left.to_pylist():
                codes, at = unpack_numbers(b["codes"]).tolist(), 0
                for r, n in zip(b["rows"], b["counts"], strict=True):
                    yield r, b"".join(map(words.__getitem__, codes[at:at + n]))
                    at += n
        return in_batches(rows(), out_schema)

    out = T.StructType([T.StructField(id_col, row), T.StructField("decoded", T.BinaryType())])
    return blocks.drop("tokens").groupBy("block").cogroup(got.groupBy("of")).applyInArrow(put_together, out)


@lru_cache(maxsize=2)
def decimals(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
               block_chars: int = BLOCK_CHARS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Encodes, decodes the ids and returns digests of both: id, n_tokens, ids_sha256, decoded_sha256."""
    some = texts_of(docs, id_col, text_col)
    row, row_arrow = row_types(some)
    blocks, answers = encoded_blocks(some, ranks, pattern, block_chars, shard_words)
    tokens = joined_tokens(answers.select("block", F.explode("tokens").alias("token")), ranks)
    back = answers.drop("tokens").unionByName(tokens, allowMissingColumns=True)
    schema = pa.schema([(id_col, row_arrow), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    most = max(ranks.values(), default=0) + 1

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        known, text = bytes_of(right), decimals(most)

        def rows() -> Iterator[tuple]:
            for r, ids in documents_of(left, right):
                ids = ids.tolist()
                yield (r, len(ids), hashlib.sha256(b" ".join(map(text.__getitem__, ids))).hexdigest(),
                       hashlib.sha256(b"".join(map(known.__getitem__, ids))).hexdigest())
        return in_batches(rows(), schema)

    out = T.StructType([T.StructField(id_col, row), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(put_together, out)


def op11_byte_bpe(spark, sf_dir, vocabulary: str | None = None):
    import public_tokenizers

    ranks = load_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, ranks, public_tokenizers.PATTERN)
