"""Operator 6: nearest neighbours by stable projections and a kd-tree.

Vectors are projected to ``DIMS`` dimensions by Gaussian (2-stable) projections.  The
top of one kd-tree, fitted on at most ``SAMPLE`` rows, deals every vector to a part of
about ``PART_ROWS``; larger parts (equal vectors) are split by a hash.  A query first
searches its own part, which gives its k-th score so far; then it goes to those parts
whose box is near enough in the projected space, and to no others.

In a part the tree goes on down to leaves of ``LEAF`` rows.  A query opens leaves in
the order of their projected distance, and verifies points in the order of theirs.
A point at distance d has a projected distance r with r^2 / d^2 distributed as
chi-square of ``DIMS`` degrees, so the search stops when a point nearer than the k-th
best so far would have come before with probability ``STOP``.  The largest inner
product is the smallest distance once each vector gets one more component,
``sqrt(max norm^2 - norm^2)``, and the query a zero.

Every row is indexed; the sample only places the cuts.  How many points are verified
depends on the vectors: few where they form clusters, about half where all directions
are alike (then the work grows with queries times rows).

Equal vectors project to equal points, so ties are complete; they go to the
smaller id.  Scores are summed in double precision component by component.

Cases: vectors that are null, empty, zero or hold a null or non-finite component,
and rows without id, take no part; vectors only meet vectors of their length;
equal rows count once; a repeated id with another vector is another candidate,
and as a query is searched on its own; fewer candidates than ``k`` are all
returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import exp, frexp

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quadsync.llm.shared import store, table
from quadsync.session import ship_package

K = 20
DIMS = 16
STOP = 0.95
LEAF = 64
PART_ROWS = 8192
#: rows the cuts of the parts are fitted on, and sample rows that a part needs at least
SAMPLE, SAMPLE_LEAF = 65_536, 16
#: queries that meet a part in one task
QUERIES_AT_ONCE = 8192
#: points that a query verifies first; doubled from step to step
FIRST_POINTS = 128
#: tables of one row per part are broadcast up to this many rows (a few bytes each)
MAX_BROADCAST = 65_536
SEED = 7

FOUND = "query_id long, query_key long, vec_id long, score double"


def chi_square_quantile(p: float, dims: int) -> float:
    """x with P(chi-square of an even number of degrees <= x) = p."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - exp(-x / 2) * total < p else (low, x)
    return x


class Space:
    """The projected space of all vectors: scale and greatest squared norm of the scaled vectors."""

    def __init__(self, dims: int, greatest: float, max_norm2: float):
        self.dims, self.scale, self.top = dims, 2.0 ** (frexp(greatest)[1] - 1), max_norm2

    def points(self, x: np.ndarray, is_query: bool = False) -> np.ndarray:
        """Projections of scaled vectors, summed in order so that equal vectors have equal points."""
        proj = _projection(x.shape[1], self.dims)
        out = np.zeros((len(x), self.dims))
        for j in range(x.shape[1]):
            out += x[:, j, None] * proj[j]
        return out if is_query else out + np.sqrt(np.maximum(0.0, self.top - (x * x).sum(1)))[:, None] * proj[-1]

    def vectors(self, col: pd.Series) -> np.ndarray:
        return np.stack(col.to_list()).astype(np.float64) / self.scale


@lru_cache(maxsize=16)
def _projection(width: int, dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width + 1, dims))


def cut(x: np.ndarray) -> tuple[int, float] | None:
    """(dimension, value) that halves the points at its median, None if all are equal."""
    spread = x.max(0) - x.min(0)
    d = int(spread.argmax())
    if not spread[d] > 0:
        return None
    v = x[:, d]
    at = float(np.median(v))
    return (d, at) if (v > at).any() else (d, float(v[v < v.max()].max()))


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves; equal points share a leaf."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        found = cut(points[rows]) if len(rows) > leaf else None
        if found is None:
            out.append(rows)
            continue
        left = points[rows, found[0]] <= found[1]
        todo += [rows[left], rows[~left]]
    return out


class Cuts:
    """The top of the kd-tree: nodes (dimension, value, left, right), parts as -1 - number."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.nodes, self.parts = [], 0
        self.root = self._grow(sample, parts)

    def _grow(self, x: np.ndarray, parts: int) -> int:
        found = cut(x) if parts > 1 and len(x) >= 2 * SAMPLE_LEAF else None
        if found is None:
            self.parts += 1
            return -self.parts
        at = len(self.nodes)
        self.nodes.append(None)
        left = x[:, found[0]] <= found[1]
        self.nodes[at] = (*found, self._grow(x[left], parts - parts // 2), self._grow(x[~left], parts // 2))
        return at

    def part(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            d, value, a, b = self.nodes[node]
            left = points[rows, d] <= value
            todo += [(a, rows[left]), (b, rows[~left])]
        return out


def in_order_dot(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += x[:, j] * q[j]
    return total


class Part:
    """The vectors of one part under the lower levels of the tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, points: np.ndarray):
        leaves = kd_leaves(points)
        order = np.concatenate(leaves)
        at = np.append(0, np.cumsum([len(r) for r in leaves]))
        self.rows = [np.arange(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.x, self.ids, self.points = x[order], ids[order], points[order]
        self.low, self.high = np.minimum.reduceat(self.points, at[:-1]), np.maximum.reduceat(self.points, at[:-1])
        self.verified = 0

    def search(self, q: np.ndarray, point: np.ndarray, own: int, k: int, top: float, limit: float, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of at least the k best vectors that score ``kth`` or more, all scaled."""
        gap = np.maximum(0.0, np.maximum(self.low - point, point - self.high))
        near = np.einsum("ij,ij->i", gap, gap)
        turn = np.argsort(near, kind="stable")
        near = near[turn]
        norm2, best, rows_out, s_out = float(q @ q), np.zeros(0), [], []
        rows, r2 = np.zeros(0, np.int64), np.zeros(0)
        done, leaves, batch = 0, 4, max(FIRST_POINTS, k)
        while True:
            radius = limit * max(0.0, top + norm2 - 2 * kth)
            ahead = int(np.searchsorted(near, radius, "right"))
            if done < ahead:
                opened = turn[done:min(ahead, done + leaves)]
                done += len(opened)
                leaves *= 2
                new = np.concatenate([self.rows[t] for t in opened])
                diff = self.points.take(new, axis=0)
                diff -= point
                d2 = np.einsum("ij,ij->i", diff, diff)
                ok = (d2 <= radius) & (self.ids[new] != own)
                rows, r2 = np.concatenate([rows, new[ok]]), np.concatenate([r2, d2[ok]])
            more = done < ahead
            ready = r2 <= (min(radius, near[done]) if more else radius)
            count = int(ready.sum())
            if not count:
                if more:
                    continue
                break
            if count > batch:
                ready = r2 <= np.partition(r2, batch - 1)[batch - 1]
            batch *= 2
            s = self.x.take(rows[ready], axis=0) @ q
            self.verified += len(s)
            rows_out.append(rows[ready])
            s_out.append(s)
            rows, r2 = rows[~ready], r2[~ready]
            best = np.concatenate([best, s])
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[-k:]
                kth = max(kth, float(best[0]))
        if not rows_out:
            return rows, r2
        rows, s = np.concatenate(rows_out), np.concatenate(s_out)
        keep = s >= kth - 1e-9 * max(1.0, abs(kth))
        return rows[keep], s[keep]


def search_part(k: int, space: Space, stop: float) -> Callable:
    limit = chi_square_quantile(stop, space.dims)

    def run(cand: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        if len(cand) and len(ask):
            cand = cand.drop_duplicates(["vec_id", "vec_key"])
            ask = ask.drop_duplicates(["vec_id", "vec_key"])
            x, qs = space.vectors(cand["vector"]), space.vectors(ask["vector"])
            part = Part(x, cand["vec_id"].to_numpy(), space.points(x))
            points, got = space.points(qs, is_query=True), []
            for q, point, own, key, bound in zip(qs, points, ask["vec_id"].to_numpy(), ask["vec_key"].to_numpy(), ask["bound"].to_numpy(np.float64) / space.scale / space.scale, strict=True):
                rows, _ = part.search(q, point, own, k, space.top, limit, -np.inf if np.isnan(bound) else float(bound))
                s = in_order_dot(part.x[rows] * space.scale, q * space.scale)
                best = np.lexsort((part.ids[rows], -s))[:k]
                got.append((np.full(len(best), own), np.full(len(best), key), part.ids[rows][best], s[best]))
            out = [np.concatenate(c) for c in zip(*got, strict=True)]
        return pd.DataFrame(dict(zip(["query_id", "query_key", "vec_id", "score"], out, strict=True)))
    return run


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def _placed(v: DataFrame, space: Space, cuts: Cuts, is_query: bool = False) -> DataFrame:
    """``v`` with the part of each vector."""
    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, g in f.groupby("dim"):
                yield g.assign(part=cuts.part(space.points(space.vectors(g["vector"]), is_query)))
    return v.mapInPandas(place, T.StructType([*v.schema.fields, T.StructField("part", T.LongType())]))


def _boxes(v: DataFrame, space: Space, cuts: Cuts, part_rows: int) -> DataFrame:
    """(dim, part, subs, low, high): one row per part, boxes of all its points."""
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby("dim"):
                p = space.points(space.vectors(g["vector"]))
                part = cuts.part(p)
                order = np.argsort(part, kind="stable")
                numbers, first, rows = np.unique(part[order], return_index=True, return_counts=True)
                yield pd.DataFrame({"dim": dim, "part": numbers, "rows": rows, "low": list(np.minimum.reduceat(p[order], first)), "high": list(np.maximum.reduceat(p[order], first))})
    parts = v.mapInPandas(partial, "dim int, part long, rows long, low array<double>, high array<double>")
    each = range(space.dims)
    return (parts.groupBy("dim", "part")
            .agg(F.sum("rows").alias("rows"), *(F.min(F.col("low")[i]).alias(f"low{i}") for i in each), *(F.max(F.col("high")[i]).alias(f"high{i}") for i in each))
            .select("dim", "part", F.ceil(F.col("rows") / part_rows).cast("long").alias("subs"),
                    F.array(*(f"low{i}" for i in each)).alias("low"), F.array(*(f"high{i}" for i in each)).alias("high")))


def _routes(space: Space, stop: float) -> Callable:
    """Queries and boxes of their length -> the parts whose box is near enough, but for the searched one."""
    limit = chi_square_quantile(stop, space.dims)

    def run(ask: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(boxes):
            boxes = boxes.loc[boxes.index.repeat(boxes["subs"])].assign(sub=lambda b: b.groupby("part").cumcount())
            low, high = np.stack(boxes["low"].to_list()), np.stack(boxes["high"].to_list())
            part, sub = boxes["part"].to_numpy(), boxes["sub"].to_numpy()
            qs = space.vectors(ask["vector"])
            points, norm2 = space.points(qs, is_query=True), (qs * qs).sum(1)
            bound = ask["bound"].to_numpy(np.float64) / space.scale / space.scale
            reach = np.where(np.isnan(bound), np.inf, limit * np.maximum(0.0, space.top + norm2 - 2 * bound))
            for i, (p, home, home_sub) in enumerate(zip(points, ask["part"], ask["sub"], strict=True)):
                gap = np.maximum(0.0, np.maximum(low - p, p - high))
                go = np.flatnonzero((np.einsum("ij,ij->i", gap, gap) <= reach[i]) & ~((part == home) & (sub == home_sub)))
                if len(go):
                    rows = ask.iloc[np.full(len(go), i)]
                    out.append(rows.assign(part=part[go], sub=sub[go]))
        return pd.concat(out, ignore_index=True) if out else ask.iloc[:0]
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K, dims: int = DIMS, stop: float = STOP,
            part_rows: int = PART_ROWS, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """vectors (vec_id, embedding) -> (query_id, rank, vec_id, score)."""
    ship_package(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType
    item = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    v = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{item}>").alias("vector"))
         .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
         .withColumn("vec_key", F.xxhash64("vector")).withColumn("dim", F.size("vector")))
    q = v.where(is_query)
    n, greatest = v.agg(F.count("*"), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    scale = Space(dims, float(greatest or 1.0), 0.0).scale
    norm2 = v.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.lit(scale)) * (x / F.lit(scale))))).first()[0]
    space = Space(dims, float(greatest or 1.0), float(norm2 or 0.0))
    some = v.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(max(1, n))) < SAMPLE).limit(SAMPLE)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, g in f.groupby("dim"):
                yield pd.DataFrame({"point": list(space.points(space.vectors(g["vector"])))})

    sample = some.mapInPandas(project, "point array<double>").toPandas()["point"].to_list()
    cuts = Cuts(np.stack(sample) if sample else np.zeros((0, dims)), -(-n // part_rows))
    boxes = store(_boxes(v, space, cuts, part_rows), "vector-parts")
    few = boxes.count() <= MAX_BROADCAST

    def known(side: DataFrame) -> DataFrame:
        return F.broadcast(side) if few else side

    subs = boxes.select("dim", "part", "subs")
    cand = _placed(v, space, cuts).join(known(subs), ["dim", "part"]).withColumn("sub", F.pmod(F.xxhash64("vec_id", "vec_key"), "subs")).drop("subs")

    def meet(ask: DataFrame) -> DataFrame:
        """Queries and vectors of the same part and sub, found pairs of each query."""
        place = ["dim", "part", "sub"]
        load = known(ask.groupBy(*place).agg(F.ceil(F.count("*") / at_once).cast("long").alias("chunks")))
        a = ask.join(load, place).withColumn("chunk", F.pmod(F.xxhash64("vec_id", "vec_key"), "chunks")).drop("chunks")
        c = cand.join(load, place).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        keys = [*place, "chunk"]
        return c.groupBy(*keys).cogroup(a.groupBy(*keys)).applyInPandas(search_part(k, space, stop), FOUND)

    # a part may hold queries only: the first box then comes by the second way
    home = (_placed(q, space, cuts, is_query=True).join(known(subs), ["dim", "part"], "left")
            .withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.coalesce("subs", F.lit(1)))).drop("subs"))
    home = store(home.withColumn("bound", F.lit(None).cast("double")), "vector-queries")
    first = store(meet(home), "vector-first")
    bounds = (first.groupBy(F.col("query_id").alias("vec_id"), F.col("query_key").alias("vec_key"))
              .agg(F.when(F.count("*") >= k, F.min("score")).alias("bound")))
    asked = home.drop("bound").join(bounds, ["vec_id", "vec_key"], "left")
    per_dim = home.groupBy("dim").agg(F.ceil(F.count("*") / at_once).cast("long").alias("chunks"))
    batches = asked.join(F.broadcast(per_dim) if few else per_dim, "dim").withColumn("batch", F.pmod(F.xxhash64("vec_id", "vec_key"), "chunks")).drop("chunks")
    asked_boxes = boxes.join(per_dim, "dim").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    routed = store(batches.groupBy("dim", "batch").cogroup(asked_boxes.groupBy("dim", "batch"))
                   .applyInPandas(_routes(space, stop), batches.schema).drop("batch"), "vector-routes")
    found = first.unionByName(meet(routed))
    w = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op6_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
