"""Operator 8: n-gram Jaccard join by a token-group matrix.

Documents are sets of ``k``-word shingles; two link when
``100 * intersection >= percent * union``.  The result is the component of
every document, exact for every link:

1. Equal sets are one class, known by a 128-bit sum of its hashes.
2. Similar sets are brought together: a set of a size class is cut by hash
   range into more parts than two linked sets of these sizes can differ in, so
   linked sets have equal parts.  Parts of two shingles or more are given (of one or more in
   classes where most parts are thin); each set knows how many of them it must share at
   least with a linked one (a set with too many thinner parts gives all).  Sets with an equal part form a *run*; a set that
   shares fewer parts than it must is linked with nothing and is done.  A passage
   that many documents share makes runs only where it fills whole parts.
3. Sets are partitioned into *groups*: by the smallest set of their runs, the
   size band, and a hash, about ``GROUP_TOKENS`` shingles each.
4. Each set asks the groups that share as many parts with it as a link must.  A group's
   parts are a matrix (part -> members): an asker goes on, and so does a member, only
   if it has a partner that shares as many parts with it as both need.  So far only
   part names were moved; the sets' shingles are fetched for those that go on.
5. A group's task holds its token union as a matrix (token -> members).  The query's
   overlap with the union bounds its overlap with every member; only a group
   whose bound reaches the threshold is opened and its members are counted exactly.  Members
   explore their own group from set to set; those already reached leave the matrix.
6. A task returns a spanning forest of the links it found, never all pairs;
   components of classes follow by star contraction.

Cases: null and empty texts have no shingles, link with nothing and are their
own component; of fewer than ``k`` words the whole sequence is one shingle;
equal rows are equal sets.  Rows that repeat an id with another text are documents of their own,
linked by their own text.  A null id is nobody's component; such a row has the
component of its text's other rows, or null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadsync.llm.bloom import marked, passes
from quadsync.llm.components import star_components
from quadsync.llm.shared import store, table
from quadsync.llm.text_arrays import mix, shingle_sets
from quadsync.session import ship_package

WORDS = 4
PERCENT = 85
GROUP_TOKENS = 1 << 18
QUERY_TOKENS = 1 << 21
#: part names of askers that one task compares with a group
ASKED_PARTS = 1 << 19
#: cells of (askers x members) counted at once
CELLS = 1 << 19


@lru_cache(maxsize=8)
def class_starts(percent: int) -> np.ndarray:
    """Smallest sizes of the size classes: a set's linked sets are in its own or a neighbouring class."""
    b = [1]
    while b[-1] < 1 << 40:
        b.append(max(b[-1] + 1, b[-1] * 100 // percent + 1))
    return np.array(b)


@lru_cache(maxsize=512)
def cut_points(size_class: int, percent: int) -> tuple[np.ndarray, np.ndarray, int, int] | None:
    """(starts of the hash ranges, salts, most parts in which linked sets differ, shingles that a
    part must have to be given) of a size class of smaller partners."""
    most = int(class_starts(percent)[size_class + 1]) - 1
    differ = (most + most * 100 // percent) * (100 - percent) // (100 + percent)
    if differ == 0:
        return None
    m = differ + differ // 2 + 2
    starts = (np.arange(m, dtype=np.float64) * (2.0 ** 64 / m)).astype(np.uint64)
    # where the smallest sets of the class would have few thick parts more than may differ, all parts but empty ones are given
    fill = int(class_starts(percent)[size_class]) / m
    thick = m * (1 - np.exp(-fill) * (1 + fill))
    return starts, mix(np.arange(m, dtype=np.uint64) + np.uint64((size_class + 1) << 40)), differ, 2 if thick > 1.1 * differ else 1


def part_hashes(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """Hashes of the parts of a sorted set, for its own size class and the one below
    (the last bit tells which: a class's parity), and how many of either a linked set shares at least."""
    n, out, need = len(s), [], [0, 0]
    own = int(np.searchsorted(class_starts(percent), n, "right")) - 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(s), out=total[1:])
    for c in (own, own - 1):
        cuts = cut_points(c, percent) if c >= 0 else None
        if cuts is None:
            continue
        starts, salts, differ, fewest = cuts
        at = np.append(np.searchsorted(s, starts), n)
        h = mix(total[at[1:]] - total[at[:-1]] + salts) & ~np.uint64(1) | np.uint64(c & 1)
        thick = at[1:] - at[:-1] >= fewest
        # of the m - differ equal parts at least, those that are thin are thin in this set
        least = int(thick.sum()) - differ
        out.append(h[thick] if least > 0 else h)
        need[c & 1] = max(1, least)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), need


def set_sums(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = mix(s).sum(dtype=np.uint64)
        b = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


SCAN = "p int, doc_id long, tag long, n long, f1 long, f2 long, need0 long, need1 long, sids binary, counts binary, parts binary"


def packed(h: np.ndarray) -> bytes:
    """47 high bits and the last one of each hash, in six bytes."""
    return ((h >> np.uint64(17) << np.uint64(1)) | (h & np.uint64(1))).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def scan_sets(k: int, percent: int, p: int) -> Callable:
    """Per document its class; per batch the part hashes of its new classes, dealt over ``p`` groups."""
    names = [c.split()[0] for c in SCAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[int]] = {}
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            f = np.zeros((b.num_rows, 4), np.int64)
            sids, hashes = [], []
            for i, s in shingle_sets(b.column(1), k):
                n[i] = len(s)
                if not len(s):
                    continue
                key = set_sums(s)
                if key not in seen:
                    h, seen[key] = part_hashes(s, percent)
                    hashes.append(h)
                    sids.append(np.full(len(h), key[0], np.int64))
                f[i] = (*key, *seen[key])
            empty = pa.nulls(b.num_rows, pa.binary())
            yield pa.record_batch([pa.array((np.arange(b.num_rows) % p).astype(np.int32)), b.column(0).cast(pa.int64()), b.column(2), pa.array(n),
                                   *(pa.array(np.ascontiguousarray(f[:, j])) for j in range(4)), empty, empty, empty], names=names)
            if hashes:
                h, sid = np.concatenate(hashes), np.concatenate(sids)
                to = ((h >> np.uint64(1)) % np.uint64(p)).astype(np.int64)
                o = np.argsort(to, kind="stable")
                h, sid = h[o], sid[o]
                at = np.searchsorted(to[o], np.arange(p + 1))
                full = np.flatnonzero(at[1:] > at[:-1])
                none = pa.nulls(len(full), pa.int64())
                blobs = []
                for j in full:  # the parts of a set lie together: its id comes once, with their number
                    own = sid[at[j]:at[j + 1]]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    blobs.append((own[first].tobytes(), np.diff(np.append(first, len(own))).astype(np.uint32).tobytes(), packed(h[at[j]:at[j + 1]])))
                yield pa.record_batch([pa.array(full.astype(np.int32)), *[none] * 7, *(pa.array([x[i] for x in blobs], pa.binary()) for i in range(3))], names=names)
    return run


RUNS = "doc_id long, tag long, n long, f1 long, f2 long, need0 long, need1 long, run long, pivot long, times long"


def run_names(h: np.ndarray, p: int) -> np.ndarray:
    """Names that differ between the groups ``p``; the last bit stays."""
    return (mix(h + (np.uint64(p) << np.uint64(48))) & ~np.uint64(1) | (h & np.uint64(1))).view(np.int64)


def find_runs(t: pa.Table) -> pa.Table:
    """The documents' classes as they came, and the runs: (run, f1, pivot, times) for
    classes with an equal part; runs of the same classes are given once, with their number."""
    is_doc = pc.is_null(t["sids"])
    docs = t.filter(is_doc).select(["doc_id", "tag", "n", "f1", "f2", "need0", "need1"])
    none = pa.nulls(docs.num_rows, pa.int64())
    for c in ("run", "pivot", "times"):
        docs = docs.append_column(c, none)
    parts = t.filter(pc.invert(is_doc))
    if not parts.num_rows:
        return docs
    h = unpacked(b"".join(parts["parts"].to_pylist()))
    sid = np.repeat(np.frombuffer(b"".join(parts["sids"].to_pylist()), np.int64), np.frombuffer(b"".join(parts["counts"].to_pylist()), np.uint32))
    o = np.lexsort((sid, h))
    h, sid = h[o], sid[o]
    new = np.append(True, (h[1:] != h[:-1]) | (sid[1:] != sid[:-1]))
    h, sid = h[new], sid[new]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(first, len(h)))
    who = np.add.reduceat(mix(sid.view(np.uint64)), first)
    several = np.flatnonzero(size > 1)
    same = np.stack([who[several], size[several].astype(np.uint64), h[first[several]] & np.uint64(1)], 1)
    _, once, number = np.unique(same, axis=0, return_index=True, return_counts=True)
    times = np.zeros(len(first), np.int64)
    times[several[once]] = number
    each = np.repeat(times, size)
    rows = each > 0
    none = pa.nulls(int(rows.sum()), pa.int64())
    runs = pa.table([none, none, none, pa.array(sid[rows]), none, none, none, pa.array(run_names(np.repeat(h[first], size)[rows], t["p"][0].as_py())),
                     pa.array(np.repeat(sid[first], size)[rows]), pa.array(each[rows])], names=docs.column_names)
    return pa.concat_tables([docs, runs])


def part_matrix(percent: int) -> Callable:
    """A group's members and askers with their part names -> those that have a partner which
    shares as many parts as both need, in one of the two cuts, and is of like size."""
    def run(t: pa.Table) -> pa.Table:
        lists = t["parts"].combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.flatten()
        name, odd, times = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        need = np.stack([t["need0"].to_numpy(), t["need1"].to_numpy()])
        n, is_member = t["n"].to_numpy(), t["member"].to_numpy(zero_copy_only=False)
        members = np.flatnonzero(is_member)
        kept = np.zeros(t.num_rows, bool)
        own = np.repeat(np.arange(t.num_rows), np.diff(at))
        place = np.cumsum(is_member) - 1
        mine = np.flatnonzero(is_member[own])
        o = mine[np.argsort(name[mine], kind="stable")]
        first = np.flatnonzero(np.append(True, name[o][1:] != name[o][:-1])) if len(o) else np.zeros(0, np.int64)
        union, ends, owner, m = name[o][first], np.append(first, len(o)), place[own[o]], len(members)
        ask = np.flatnonzero(~is_member | (t["part"][0].as_py() == 0)) if m and len(union) else members[:0]
        step = max(1, CELLS // max(1, m))
        for a in range(0, len(ask), step):
            some = ask[a:a + step]
            lens = at[some + 1] - at[some]
            entry = np.repeat(at[some] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            asker = np.repeat(np.arange(len(some)), lens)
            pos = np.minimum(np.searchsorted(union, name[entry]), len(union) - 1)
            hit = union[pos] == name[entry]
            entry, asker, pos = entry[hit], asker[hit], pos[hit]
            size = ends[pos + 1] - ends[pos]
            shared = np.zeros((2, len(some) * m), np.int64)
            cut = np.append(0, np.cumsum(size))
            b = 0
            while b < len(entry):
                c = max(b + 1, int(np.searchsorted(cut, cut[b] + 2 * CELLS, "right")) - 1)
                k = size[b:c]
                cell = np.repeat(asker[b:c] * m, k) + owner[np.repeat(ends[pos[b:c]] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                for parity in (0, 1):
                    w = np.repeat(np.where(odd[entry[b:c]] == bool(parity), times[entry[b:c]], 0), k)
                    shared[parity] += np.bincount(cell, w, len(some) * m).astype(np.int64)
                b = c
            near = np.zeros((len(some), m), bool)
            for parity in (0, 1):
                x, y = need[parity][some][:, None], need[parity][members][None, :]
                near |= (x > 0) & (y > 0) & (shared[parity].reshape(len(some), m) >= np.maximum(x, y))
            x, y = n[some][:, None], n[members][None, :]
            near &= (some[:, None] != members[None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
            kept[some[near.any(1)]] = True
            kept[members[near.any(0)]] = True
        return t.filter(pa.array(kept)).select(["g", "rep", "sid", "n", "member"])
    return run


def tokens_of(k: int, wanted) -> Callable:
    """The sets of documents whose ids are marked in ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column(0)))
            b = b.filter(pa.array(passes(b.column(0).to_numpy(zero_copy_only=False), wanted.value)))
            blobs, f1 = [], []
            for _, s in shingle_sets(b.column(1), k):
                blobs.append(s.tobytes())
                f1.append(set_sums(s)[0])
            yield pa.record_batch([b.column(0), pa.array(f1, pa.int64()), pa.array(blobs, pa.binary())], names=["t_rep", "t_f1", "tokens"])
    return run


class Matrix:
    """Token union of some sets, with the sets that hold each token."""

    def __init__(self, sets: list[np.ndarray], which: np.ndarray):
        self.which = which
        token = np.concatenate([sets[j] for j in which])
        owner = np.repeat(np.arange(len(which)), [len(sets[j]) for j in which])
        o = np.argsort(token, kind="stable")
        token, self.owner = token[o], owner[o]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        self.union, self.at = token[first], np.append(first, len(token))
        self.size = np.array([len(sets[j]) for j in which])

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """The sets that link with ``s``; the group is opened only if its union holds enough of ``s``."""
        pos = np.searchsorted(self.union, s)
        pos = np.minimum(pos, len(self.union) - 1)
        pos = pos[self.union[pos] == s]
        if 100 * len(pos) < percent * len(s):
            return self.which[:0]
        n = self.at[pos + 1] - self.at[pos]
        hit = np.repeat(self.at[pos] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        both = np.bincount(self.owner[hit], minlength=len(self.which))
        return self.which[100 * both >= percent * (len(s) + self.size - both)]


def open_group(percent: int) -> Callable:
    """A group's members and queries -> spanning forest (a, b) of the links found."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        reps = pdf["sid"].to_numpy()
        sets = [np.frombuffer(t, np.uint64) for t in pdf["tokens"]]
        is_member = pdf["member"].to_numpy()
        members, askers = np.flatnonzero(is_member), np.flatnonzero(~is_member)
        edges: list[tuple[int, int]] = []
        if not len(members):
            return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")
        matrix = Matrix(sets, members)
        parent = np.arange(len(reps))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for q in askers:
            for j in matrix.linked(sets[q], percent):
                x, y = root(q), root(j)
                if x != y:
                    parent[x] = y
                    edges.append((reps[q], reps[j]))
        if pdf["part"].iloc[0] == 0 and len(members) > 1:
            left = np.zeros(len(reps), bool)
            left[members] = True
            for start in members:
                todo = [start] if left[start] else []
                left[start] = False
                while todo:
                    x = todo.pop()
                    found = [j for j in matrix.linked(sets[x], percent) if left[j]]
                    for j in found:
                        left[j] = False
                        edges.append((reps[x], reps[j]))
                    todo += found
                    if 2 * left.sum() < len(matrix.which):
                        if not left.any():
                            break
                        matrix = Matrix(sets, np.flatnonzero(left))
        return pd.DataFrame([e for e in edges if e[0] != e[1]], columns=["a", "b"]).astype("int64")
    return run


def jaccard_classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, group_tokens: int = GROUP_TOKENS, query_tokens: int = QUERY_TOKENS, asked_parts: int = ASKED_PARTS) -> DataFrame:
    """docs (doc_id, text, tag) -> (doc_id, tag, n, root, component_id), a row per row.

    ``root`` names the component of a row's text (null without shingles), ``component_id`` is its smallest id."""
    spark = docs.sparkSession
    ship_package(spark)
    # as many tasks of part names as the input has, so that they keep their size when it grows
    p = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("tag").cast("long").alias("tag"))
    found = store(docs.mapInArrow(scan_sets(k, percent, p), SCAN).groupBy("p").applyInArrow(find_runs, RUNS), "runs")
    rows = found.where("run IS NULL").select("doc_id", "tag", "n", "f1", "f2", "need0", "need1")
    odd = F.col("run").bitwiseAND(1) == 1
    runs = found.where("run IS NOT NULL").select("run", F.col("f1").alias("sid"), "pivot", "times", odd.alias("odd"))
    classes = (rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.max("need0").alias("need0"), F.max("need1").alias("need1"))
               .where("rep IS NOT NULL"))
    classes = store(classes, "classes")

    shares = runs.groupBy("sid").agg(F.min("pivot").alias("label"), F.sum(F.when(F.col("odd"), 0).otherwise(F.col("times"))).alias("n0"), F.sum(F.when(F.col("odd"), F.col("times")).otherwise(0)).alias("n1"))
    sets = (shares.join(classes, shares["sid"] == classes["f1"])
            .withColumn("ok0", F.expr("need0 > 0 AND n0 >= need0")).withColumn("ok1", F.expr("need1 > 0 AND n1 >= need1")).where("ok0 OR ok1")
            .select("sid", "rep", "n", "label", "ok0", "ok1", "need0", "need1", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).alias("band")))
    sets = store(sets, "candidates")
    sizes = store(sets.groupBy("label", "band").agg(F.ceil(F.sum("n") / group_tokens).alias("chunks")), "group-chunks")
    sets = sets.join(sizes, ["label", "band"]).withColumn("g", F.xxhash64("label", "band", F.pmod(F.xxhash64("sid"), F.col("chunks")))).drop("label", "chunks")
    sets = store(sets, "groups")

    asked = runs.join(sets, "sid").where("IF(odd, ok1, ok0)").select("run", "odd", "times", "rep", "sid", "n", "need0", "need1", "band", "g")
    there = asked.select("run", F.col("g").alias("to"), F.col("band").alias("to_band")).distinct()
    near = (F.col("band") == F.col("to_band") - 1) | ((F.col("band") == F.col("to_band")) & (F.col("g") < F.col("to")))
    # a linked member shares so many parts alone, so a group that shares fewer is not asked
    who = ["rep", "sid", "n", "need0", "need1"]
    names = F.collect_list(F.struct("run", "odd", "times")).alias("parts")
    shared = (asked.join(there, "run").where(near).groupBy(F.col("to").alias("g"), *who)
              .agg(F.sum(F.when(F.col("odd"), 0).otherwise(F.col("times"))).alias("n0"), F.sum(F.when(F.col("odd"), F.col("times")).otherwise(0)).alias("n1"), names))
    queries = store(shared.where("(need0 > 0 AND n0 >= need0) OR (need1 > 0 AND n1 >= need1)").drop("n0", "n1"), "queries")
    owners = store(asked.groupBy("g", *who).agg(names), "members")

    def split(members: DataFrame, askers: DataFrame, size, most: int) -> DataFrame:
        """A group's members with each part of about ``most`` of its askers' size."""
        count = (members.groupBy("g").agg(F.count("*").alias("own"))
                 .join(askers.groupBy("g").agg(F.sum(size).alias("asking")), "g", "left")
                 .where("own > 1 OR asking > 0")
                 .select("g", F.greatest(F.lit(1), F.ceil(F.coalesce("asking", F.lit(0)) / most)).cast("int").alias("parts_of")))
        count = store(count, "group-sizes")
        all_members = members.join(count, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts_of") - 1))).withColumn("member", F.lit(True))
        each = askers.join(count, "g").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts_of")).cast("int")).withColumn("member", F.lit(False))
        return all_members.unionByName(each).drop("parts_of")

    compared = split(owners, queries, F.size("parts"), asked_parts)
    kept = store(compared.groupBy("g", "part").applyInArrow(part_matrix(percent), "g long, rep long, sid long, n long, member boolean"), "near")
    kept = kept.distinct()
    work = store(split(kept.where("member").drop("member"), kept.where("NOT member").drop("member"), F.col("n"), query_tokens), "group-work")

    # the texts stay where they are: marks of the ids that have work go to them
    ids = store(work.select("rep").distinct(), "wanted")
    wanted = spark.sparkContext.broadcast(marked(ids, ids.count()))
    tokens = docs.select("doc_id", "text").mapInArrow(tokens_of(k, wanted), "t_rep long, t_f1 long, tokens binary")
    links = (work.join(tokens, (F.col("t_rep") == F.col("rep")) & (F.col("t_f1") == F.col("sid"))).select("g", "part", "sid", "member", "tokens")
             .groupBy("g", "part").applyInPandas(open_group(percent), "a long, b long"))
    roots = star_components(links).select(F.col("a").alias("sid"), F.col("b").alias("root"))

    named = store(classes.join(roots, classes["f1"] == roots["sid"], "left").select("f1", "f2", "n", "rep", F.coalesce("root", "f1").alias("root")), "class-roots")
    # only classes that hang below another one can lower its id
    lower = named.where("root <> f1").groupBy(F.col("root").alias("of")).agg(F.min("rep").alias("low"))
    least = named.where("root = f1").join(lower, F.col("root") == F.col("of")).select("of", F.least("rep", "low").alias("least"))
    named = named.join(store(least, "component-ids"), F.col("root") == F.col("of"), "left")
    named = named.select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), F.col("n").alias("cn"), "root", F.coalesce("least", "rep").alias("component_id"))
    named = store(named, "components")
    return (rows.join(named, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
            .select("doc_id", "tag", "n", "root", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, **sizes: int) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), a row per row."""
    return jaccard_classes(docs.select("doc_id", "text", F.lit(0).alias("tag")), k, percent, **sizes).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op8_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
