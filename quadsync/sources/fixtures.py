"""Test inputs derived from the driver tables (FIXTURES §3-§5, our design).

Rules, a drifted publication, change messages from ``events`` and the
before/after states of the live batch. Everything is derived by Spark from
the given tables, so the work grows with them.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadsync.functions.terms import canonical_object
from quadsync.operators.export import expected, expected_rows
from quadsync.sources.indexed import FilteredSource, FrameSource, LayeredSource
from quadsync.sources.packed import TERM_COLS, SubjectRows, in_short, predicate_of, spelled_term
from quadsync.sources.rules import ExportRule, ExportSpec
from quadsync.sources.tables import TABLES_USED, quad_store, quads_from_tables, read_table, store_path, stored_snapshot
from quadsync.vocab import EVENTS_GRAPH, QUAD_COLS, RDF_TYPE, RES_NS, TRIPLE_COLS, pred, typ

P = pred

BASE_RULES = (
    ExportRule(0, typ("Nation"), (P("n_name"),), (P("n_regionkey"),)),
    ExportRule(1, typ("Customer"), (P("c_name"), P("c_mktsegment"), P("c_nationkey")),
               (P("c_nationkey"), P("n_regionkey")), strict=True),
    ExportRule(2, typ("Order"), (P("o_orderstatus"), P("o_totalprice"), P("o_custkey")),
               (P("o_custkey"), P("c_nationkey"), P("n_regionkey")),
               graphs=("urn:g:orders/O", "urn:g:orders/F")),
    ExportRule(3, typ("Line"), (P("l_quantity"), P("l_orderkey"), P("l_partkey")),
               (P("l_orderkey"), P("o_custkey"), P("c_nationkey"), P("n_regionkey"))),
    ExportRule(4, typ("Part"), (P("p_name"), P("p_brand"), "^" + P("l_partkey")),
               ("^" + P("l_partkey"), P("l_orderkey"), P("o_custkey"), P("c_nationkey"), P("n_regionkey"))),
    ExportRule(5, typ("Document"), (P("lang"), P("n_chars")), (),
               graphs=("documents/src1",), graphs_regex=True,
               filter_patterns=((P("quality"), "o_key = '1'"),)),
)
LIVE_RULES = BASE_RULES + (
    ExportRule(6, typ("ActiveUser"), (P("bought"), P("lastViewed"), P("c_name")),
               (P("c_nationkey"), P("n_regionkey"))),
    ExportRule(7, typ("Click"), (P("by"),), (P("by"), P("c_nationkey"), P("n_regionkey"))),
)


def base_spec(**kw) -> ExportSpec:
    return ExportSpec(rules=BASE_RULES, **kw)


def live_spec(**kw) -> ExportSpec:
    return ExportSpec(rules=LIVE_RULES, **kw)


def resource_key(s: Column) -> Column:
    """The number after ``/`` of a resource URI (for lines: the order number)."""
    return F.regexp_extract(s, r"^urn:r:[a-z]+/([0-9]+)", 1).try_cast("bigint")


# ------------------------------------------------------ drifted publication

def drifted_publication(quads: DataFrame, spec: ExportSpec, expected_set: DataFrame | None = None) -> DataFrame:
    """FIXTURES §4: expected set A with holes, stale copies, out-of-scope
    subjects and untyped orphans."""
    a = expected_rows(quads, spec) if expected_set is None else SubjectRows.of(
        expected_set.select("s", in_short(F.struct(*TERM_COLS)).alias("x")).select("s", "x.*").distinct())
    return drifted_rows(quads, spec, a).frame()


def drifted_rows(quads, spec: ExportSpec, a: SubjectRows) -> SubjectRows:
    """FIXTURES §4 by subject: a triple and its stale copy stay in their subject's row."""
    k = resource_key(F.col("s"))
    old = lambda x: F.concat(x["o"], F.lit("-stale"))
    stale = F.transform(F.filter(F.transform("terms", spelled_term), lambda x: (x["o_kind"] == "literal") & (x["o_dt"] == "")),
                        lambda x: in_short(F.struct(x["p"].alias("p"), old(x).alias("o"), x["o_kind"].alias("o_kind"), x["o_dt"].alias("o_dt"), x["o_lang"].alias("o_lang"), old(x).alias("o_key"))))
    kept = a.df.where(k % 7 != 3).select("s", F.when(k % 11 == 5, F.array_distinct(F.concat("terms", stale))).otherwise(F.col("terms")).alias("terms"))
    unscoped = ExportSpec(rules=tuple(ExportRule(r.rule_no, r.type, r.properties, (), r.graphs, r.graphs_regex,
                                                 r.filter_expr, r.filter_patterns, r.strict) for r in spec.rules),
                          concept_scheme=spec.concept_scheme, publication_graph=spec.publication_graph)
    outside = expected_rows(quads, unscoped).df.where(k % 13 == 1).join(a.df.select("s"), "s", "left_anti")
    names = F.filter("terms", lambda x: predicate_of(x) == P("c_name"))
    ghost = F.concat(F.lit(RES_NS + "ghost/"), k.cast("string"))
    orphans = SubjectRows.of(a.df.where(F.col("s").startswith(RES_NS + "customer/") & (k % 50 == 0))
                             .select(ghost.alias("s"), F.inline(names)).distinct()).df
    # subjects of the one set, of none of it, and of no table: the three have no subject in common
    return SubjectRows(kept.unionByName(outside).unionByName(orphans))


# --------------------------------------------------- change messages (§5)

def _term_row(op: str, j: int, s: Column, p: str, o: Column, kind: str = "uri") -> Column:
    return F.struct(F.lit(op).alias("op"), F.lit(j).alias("j"), s.alias("s"), F.lit(p).alias("p"),
                    o.alias("o"), F.lit(kind).alias("o_kind"))


def changes_from_events(events: DataFrame) -> DataFrame:
    """Explode ``events`` into change rows (FIXTURES §5).

    ``(msg_id, cs_no, op, pos, ts, event_id, g, s, p, o, o_kind, o_dt, o_lang, o_key)``
    """
    cust = F.concat(F.lit(RES_NS + "customer/"), F.col("user_id").cast("string"))
    ev = F.concat(F.lit(RES_NS + "event/"), F.col("event_id").cast("string"))
    part = F.concat(F.lit(RES_NS + "part/"),
                    (F.get_json_object("props", "$.k").cast("bigint") % 20).cast("string"))
    t = F.col("event_type")
    rows = (F.when(t == "signup", F.array(_term_row("insert", 0, cust, RDF_TYPE, F.lit(typ("ActiveUser")))))
            .when(t == "click", F.array(_term_row("insert", 0, ev, RDF_TYPE, F.lit(typ("Click"))),
                                        _term_row("insert", 1, ev, P("by"), cust)))
            .when(t == "purchase", F.array(_term_row("insert", 0, cust, P("bought"), part)))
            .when(t == "error", F.array(_term_row("delete", 0, cust, P("bought"), part)))
            .when(t == "view", F.array(_term_row("delete", 0, cust, P("lastViewed"), part),
                                       _term_row("insert", 1, cust, P("lastViewed"), part))))
    x = events.select("event_id", "ts", F.explode(rows).alias("c"))
    out = x.select(
        (F.col("event_id") / 100).cast("bigint").alias("msg_id"),
        ((F.col("event_id") % 100) / 10).cast("int").alias("cs_no"),
        F.col("c.op").alias("op"),
        ((F.col("event_id") % 10) * 2 + F.col("c.j")).cast("int").alias("pos"),
        "ts", "event_id", F.lit(EVENTS_GRAPH).alias("g"),
        F.col("c.s").alias("s"), F.col("c.p").alias("p"), F.col("c.o").alias("o"),
        F.col("c.o_kind").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"),
    )
    return out.withColumn("o_key", canonical_object("o", "o_kind", "o_dt"))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_from_events(read_table(spark, sf_dir, "events"))


def split_message(changes: DataFrame) -> int:
    """M0 = (max(msg_id) + 1) div 2 (one scalar aggregate)."""
    m = changes.agg(F.max("msg_id")).first()[0]
    return (int(m) + 1) // 2 if m is not None else 0


def state_of(changes: DataFrame) -> DataFrame:
    """Triples present after applying changes in order (last change wins by
    event, delete before insert within an event), as quads in the events graph."""
    op_rank = F.when(F.col("op") == "delete", 0).otherwise(1)
    last = F.max(F.struct(F.col("event_id"), op_rank.alias("_r"), F.col("op")))
    return (changes.groupBy(*TRIPLE_COLS, "o_key").agg(last.alias("_l"))
            .where(F.col("_l.op") == "insert")
            .select(F.lit(EVENTS_GRAPH).alias("g"), *TRIPLE_COLS, "o_key").select(*QUAD_COLS))


class LiveFixture:
    """Before/after states of the live batch (FIXTURES §5.1).

    ``source``, ``source_old`` and ``pub`` answer by URI; the publication before is a stored
    snapshot, built once per input when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, spec: ExportSpec | None = None):
        from quadsync.session import cut_lineage

        self.spec = spec or live_spec()
        self.base = quads_from_tables(spark, sf_dir)
        tables = quad_store(spark, sf_dir)
        self.changes = cut_lineage(event_changes(spark, sf_dir))
        self.m0 = split_message(self.changes)
        early = cut_lineage(state_of(self.changes.where(F.col("msg_id") < self.m0)))
        late = cut_lineage(state_of(self.changes))
        self.batch = self.changes.where(F.col("msg_id") >= self.m0)
        self.source_before, self.source_after = LayeredSource(tables, added=early), self.base.unionByName(late)
        self.source_old, self.source = self.source_before, LayeredSource(tables, added=late)
        self.publish = lambda: publication_snapshot(spark, sf_dir, "livepub", self.spec, lambda: self.source_before, ("events",))

    @cached_property
    def pub(self):
        """Computed for those that ask it."""
        return self.publish()

    @property
    def pub_before(self) -> DataFrame:
        return self.pub.frame()


def publication_snapshot(spark: SparkSession, sf_dir: str, name: str, spec: ExportSpec, quads, more: tuple[str, ...] = ()):
    """The expected publication of ``quads()`` as a stored snapshot."""
    tag = hashlib.sha1(repr(spec).encode()).hexdigest()[:8]
    path = store_path(spark, sf_dir, f"{name}-snapshot-{tag}", (*TABLES_USED, *more))
    return stored_snapshot(spark, path, [*TRIPLE_COLS, "o_key"], lambda: expected(quads(), spec))


def _message(quads: DataFrame, op: str) -> DataFrame:
    return (quads.select(*TRIPLE_COLS, "o_key").distinct()
            .select(F.lit(0).cast("bigint").alias("msg_id"), F.lit(0).alias("cs_no"), F.lit(op).alias("op"), *TRIPLE_COLS, "o_key"))


def link_fixture(spark: SparkSession, sf_dir: str):
    """FIXTURES §5.2: links ``line l_orderkey order`` of orders with key % 17 = 2
    are missing before and inserted by one message. Returns
    (source_after, publication_before (empty), message changes)."""
    is_link = (F.col("p") == P("l_orderkey")) & (resource_key(F.col("o")) % 17 == 2)
    base = quads_from_tables(spark, sf_dir)
    empty_pub = FrameSource(spark.createDataFrame([], base.select(*TRIPLE_COLS, "o_key").schema))
    return quad_store(spark, sf_dir), empty_pub, _message(base.where(is_link), "insert")


def split_delete_fixture(spark: SparkSession, sf_dir: str, spec: ExportSpec | None = None):
    """FIXTURES §5.3: the message deletes all triples of lines of orders with
    key % 17 = 2; the source after also lacks those orders. Returns
    (source_after, publication_before = A of the base, message changes)."""
    spec = spec or base_spec()
    k = resource_key(F.col("s"))
    line_of = F.col("s").startswith(RES_NS + "line/") & (k % 17 == 2)
    order_of = F.col("s").startswith(RES_NS + "order/") & (k % 17 == 2)
    base = quads_from_tables(spark, sf_dir)
    pub = publication_snapshot(spark, sf_dir, "basepub", spec, lambda: quad_store(spark, sf_dir))
    return FilteredSource(quad_store(spark, sf_dir), ~(line_of | order_of)), pub, _message(base.where(line_of), "delete")


class RelationFixture:
    """FIXTURES §5.4: the links ``predicate`` of subjects with key % 17 = 2 are in the source on one side
    of the message only (``op``): before a delete, after an insert."""

    def __init__(self, spark: SparkSession, sf_dir: str, predicate: str, op: str):
        self.spec, full, base = base_spec(), quad_store(spark, sf_dir), quads_from_tables(spark, sf_dir)
        link = (F.col("p") == predicate) & (resource_key(F.col("s")) % 17 == 2)
        rest = FilteredSource(full, ~link)
        self.before, self.after = (full, rest) if op == "delete" else (rest, full)
        self.message = _message(base.where(link), op)
        name = "basepub" if op == "delete" else f"pub-without-{predicate.rsplit(':', 1)[-1]}"
        # the tables themselves are asked by their columns
        whole = full if op == "delete" else rest
        self.publish = lambda: publication_snapshot(spark, sf_dir, name, self.spec, lambda: whole)

    @cached_property
    def pub(self):
        """Computed for those that ask it."""
        return self.publish()
