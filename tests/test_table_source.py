"""Quads asked of the tables themselves: nothing is stored, every question has the answer of the whole frame."""

import os

import duckdb
import pytest

from quadsync.operators.export import expected
from quadsync.session import cut_lineage
from quadsync.sources.fixtures import LiveFixture, RelationFixture, base_spec, link_fixture, split_delete_fixture
from quadsync.sources.indexed import FrameSource, bundles
from quadsync.plans import heal
from quadsync.plans.catalog import QUERIES
from quadsync.sources.tables import distinct_literals, quad_store, quads_from_tables, stored_index, typed_literals
from quadsync.vocab import QUAD_COLS, RDF_TYPE, XSD_DATETIME, XSD_DECIMAL, XSD_INTEGER, pred

ROWS = {
    "region": "SELECT 3 AS r_regionkey, 'ASIA' AS r_name",
    "nation": "SELECT 1 AS n_nationkey, 'N1' AS n_name, 3 AS n_regionkey",
    "customer": "SELECT * FROM (VALUES (1, 'a', 1, -5.0, 'x'), (1, 'a', 1, -5.0, 'x'), (2, NULL, NULL, 7.0, NULL)) t(c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)",
    "part": "SELECT 1 AS p_partkey, 'p' AS p_name, 'b' AS p_brand, 't' AS p_type, 4 AS p_size, 1.5 AS p_retailprice",
    "supplier": "SELECT 1 AS s_suppkey, 's' AS s_name, 1 AS s_nationkey, 2.0 AS s_acctbal",
    "orders": "SELECT 1 AS o_orderkey, 1 AS o_custkey, 'O' AS o_orderstatus, 9.5 AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, 'h' AS o_orderpriority",
    "lineitem": "SELECT 1 AS l_orderkey, 1 AS l_partkey, 1 AS l_suppkey, x AS l_linenumber, 1.0 AS l_quantity, 1.0 AS l_extendedprice, 0.0 AS l_discount, 0.0 AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2024-01-02' AS l_shipdate FROM (VALUES (1), (1), (NULL)) t(x)",
    "documents": "SELECT 1 AS doc_id, 't' AS text, NULL::VARCHAR AS lang, 'src1' AS source, 1 AS n_chars",
    "labels": "SELECT 1 AS doc_id, 1 AS quality, 0 AS toxic",
    "events": "SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-01', 1, 'signup', 1.0, '{\"k\": 1}'), (101, TIMESTAMP '2024-01-02', 1, 'click', 1.0, '{\"k\": 1}'), (230, TIMESTAMP '2024-01-03', 1, 'purchase', 1.0, '{\"k\": 1}')) t(event_id, ts, user_id, event_type, value, props)",
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    for name, q in ROWS.items():
        con.execute(f"COPY ({q}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return str(d)


def test_table_quads_answer_like_the_frame_and_store_nothing(spark, tables):
    kept = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    before = {x for x in os.listdir(kept.removeprefix("file:")) if x.startswith(("quadstore", "quadindex"))}
    store, frame = quad_store(spark, tables), cut_lineage(quads_from_tables(spark, tables))
    whole = FrameSource(frame)
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    for preds in ([pred("l_orderkey")], [RDF_TYPE], [pred("c_name"), pred("l_quantity"), RDF_TYPE]):
        assert key(store.having(preds).collect()) == key(frame.where(frame.p.isin(preds)).collect())
        spread = bundles(store, preds).selectExpr("g", "s", "inline(terms)").where("o IS NOT NULL")
        assert key(spread.collect()) == key(frame.where(frame.p.isin(preds)).select("g", "s", "p", "o", "o_kind", "o_dt", "o_lang", "o_key").collect())
    uris = spark.createDataFrame([("urn:r:customer/1",), ("urn:r:line/1-1",), ("urn:r:nobody/1",), (None,)], "uri string")
    assert key(store.about(uris).collect()) == key(whole.about(uris).collect())
    assert key(store.pointing(uris, [pred("o_custkey")]).collect()) == key(whole.pointing(uris, [pred("o_custkey")]).collect())
    assert key(expected(store, base_spec()).collect()) == key(expected(frame, base_spec()).collect())
    after = {x for x in os.listdir(kept.removeprefix("file:")) if x.startswith(("quadstore", "quadindex"))}
    assert after == before


def test_live_states_are_read_from_the_tables(spark, tables):
    """No copy of all quads by subject and object; the publication's rows are computed once."""
    kept = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(kept))
    fx = LiveFixture(spark, tables)
    source = FrameSource(cut_lineage(fx.source_after))
    uris = spark.createDataFrame([("urn:r:customer/1",), ("urn:r:line/1-1",), ("urn:r:event/101",)], "uri string")
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert key(fx.source.about(uris).collect()) == key(source.about(uris).collect()) != []
    assert key(fx.source.pointing(uris, [pred("by"), pred("o_custkey")]).collect()) == key(source.pointing(uris, [pred("by"), pred("o_custkey")]).collect()) != []
    assert key(fx.pub_before.collect()) == key(expected(fx.source_before, fx.spec).select(*fx.pub_before.columns).collect())
    link_fixture(spark, tables), split_delete_fixture(spark, tables), RelationFixture(spark, tables, pred("c_nationkey"), "delete")
    assert not [x for x in set(os.listdir(kept)) - before if x.startswith("quadindex")]


def test_a_stored_index_computes_its_rows_once(spark, tmp_path, mk):
    """Rows were computed for their number and for either order."""
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for b in rows:
            seen.add(len(b))
            yield b
    quads = mk([("urn:g:a", f"urn:r:{i}", "urn:p:to", "urn:r:0") for i in range(7)])
    index = stored_index(spark, str(tmp_path / "index"), quads.columns, lambda: quads.mapInPandas(count, quads.schema))
    assert seen.value == 7 and index.frame().count() == 7


def test_healing_takes_the_expected_set_that_is_at_hand(spark, tables, monkeypatch):
    """The expected set is computed once, for the drifted publication and for the healing."""
    def again(*_a, **_k):
        raise AssertionError("computed again")
    monkeypatch.setattr(heal, "expected", again)
    assert QUERIES["heal_report_counts"](spark, tables).where("n_triples > 0").count() == QUERIES["heal_report_counts"](spark, tables).count()


def test_literals_are_told_apart_at_their_subject(spark, tables):
    """one shuffle, of table rows."""
    types = (XSD_INTEGER, XSD_DECIMAL, XSD_DATETIME)
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    found = distinct_literals(spark, tables, types)
    assert key(found.collect()) == key(typed_literals(spark, tables, types).select(*QUAD_COLS[1:]).distinct().collect()) != []
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("hashpartitioning") == plan.count("hashpartitioning(s#") and plan.count("REPARTITION_BY_COL") == plan.count("hashpartitioning")
