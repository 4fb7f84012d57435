"""What is shuffled: short terms and keys, one count of a bag, no publication that nobody asks for."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quadsync.operators.diff import bag_diff
from quadsync.operators.export import expected
from quadsync.operators.scope import reach
from quadsync.plans.catalog import QUERIES
from quadsync.session import cut_lineage
from quadsync.sources import fixtures
from quadsync.sources.fixtures import base_spec, live_spec
from quadsync.sources.indexed import LayeredSource
from quadsync.sources.packed import in_short, spelled
from quadsync.sources.tables import quad_store, quads_from_tables
from quadsync.vocab import QUAD_COLS, RDF_TYPE, TRIPLE_COLS, XSD_DATETIME, XSD_DECIMAL, pred, typ
from tests.test_table_source import ROWS


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("short")
    con = duckdb.connect()
    for name, q in ROWS.items():
        con.execute(f"COPY ({q}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return str(d)


def key(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_short_terms_are_spelled_as_they_were(spark):
    """any term has one short form and comes back whole."""
    rows = [(RDF_TYPE, typ("Order"), "uri", "", "", typ("Order")), (RDF_TYPE, "urn:x", "uri", "", "", "urn:x"), (pred("o_custkey"), "urn:r:customer/1", "uri", "", "", "urn:r:customer/1"),
            (pred("o_custkey"), "urn:r:part/1", "uri", "", "", "urn:r:part/1"), (pred("o_totalprice"), "2.50", "literal", XSD_DECIMAL, "", "2.5"),
            (pred("o_totalprice"), "+2.5", "literal", XSD_DECIMAL, "", "2.5"), (pred("o_orderdate"), "2024-01-01T00:00:00", "literal", XSD_DATETIME, "", "2024-01-01T00:00:00.000000"),
            (pred("source"), "a", "literal", "", "en", "a"), (pred("source"), "a", "literal", "", None, "a"), (pred("c_name"), "a-stale", "literal", "", "", "a-stale"), ("urn:p:no", "1", "literal", None, "", None)]
    cols = ["p", "o", "o_kind", "o_dt", "o_lang", "o_key"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    short = df.select(in_short(F.struct(*cols)).alias("x")).select("x.*")
    assert key(short.select(*spelled([])).collect()) == key(df.select(*cols).collect())
    assert short.where("t IS NOT NULL").count() == 7 and short.distinct().count() == len(rows)


def test_expected_set_of_layers_is_told_apart_in_short(spark, tables):
    """quads added in spelled form meet the same ones of the tables; only short terms are shuffled."""
    frame = cut_lineage(quads_from_tables(spark, tables))
    extra = frame.where(F.col("p") != pred("c_name")).unionByName(frame.withColumn("s", F.concat("s", F.lit("0"))))
    found = expected(LayeredSource(quad_store(spark, tables), added=extra), live_spec())
    assert key(found.collect()) == key(expected(frame.unionByName(extra), live_spec()).collect()) != []
    plan = plan_of(expected(quad_store(spark, tables), base_spec()))
    assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "o_key#" in x]


def test_paths_are_walked_by_keys(spark, tables):
    """the nodes are those of the quads, a null one included; URIs are not shuffled."""
    store, frame = quad_store(spark, tables), cut_lineage(quads_from_tables(spark, tables))
    spec = base_spec(concept_scheme="urn:r:region/1")
    mine, theirs = reach(store, spec), reach(frame, spec)
    assert mine.keys() == theirs.keys()
    for suffix, nodes in mine.items():
        assert key(nodes.collect()) == key(theirs[suffix].collect())
        assert all("k0#" in x or "far0#" in x for x in plan_of(nodes).splitlines() if "hashpartitioning" in x)


def test_types_are_counted_by_keys(spark, tables):
    """F32"""
    frame = quads_from_tables(spark, tables).where(F.col("p") == RDF_TYPE)
    want = frame.groupBy("g", F.col("o").alias("type")).agg(F.countDistinct("s").alias("n_subjects"))
    found = QUERIES["type_scan_by_graph"](spark, tables)
    assert key(found.collect()) == key(want.collect()) != []
    assert not [x for x in plan_of(found).splitlines() if "hashpartitioning" in x and "urn:r:" in x]


def test_literals_are_decoded_after_they_are_told_apart(spark, tables):
    """the only shuffle is that of the table rows."""
    plan = plan_of(QUERIES["decode_literals"](spark, tables))
    assert plan.count("hashpartitioning") == plan.count("hashpartitioning(s#") == 1


def test_bag_difference_counts_either_side_once(spark):
    """both sides were shuffled twice."""
    cols = ", ".join(f"{c} string" for c in TRIPLE_COLS)
    row = lambda s, lang="": (s, "p", "o", "literal", "", lang)
    a = spark.createDataFrame([row("a"), row("a"), row("a"), row("b"), row("n", None)], cols)
    b = spark.createDataFrame([row("a"), row("b"), row("b"), row("c"), row("n", None)], cols)
    diff = bag_diff(a, b)
    assert sorted((r.op, r.s) for r in diff.collect()) == [("delete", "b"), ("delete", "c"), ("insert", "a"), ("insert", "a")]
    assert diff.columns == [*TRIPLE_COLS, "op"]
    assert plan_of(diff).count("hashpartitioning") == 1


@pytest.mark.parametrize("name", ["dispatch_streams", "reach_maintained", "reach_retracted"])
def test_no_publication_is_computed_that_is_not_asked(spark, tables, monkeypatch, name):
    """F15, F19, F20"""
    def built(*_a, **_k):
        raise AssertionError("publication computed")
    monkeypatch.setattr(fixtures, "publication_snapshot", built)
    QUERIES[name](spark, tables).collect()


def test_a_publication_is_stored_once(spark, tables):
    """not once more by subject and by object."""
    pub = fixtures.LiveFixture(spark, tables).pub
    assert all("b=" not in f and "/by_" not in f for f in pub.frame().inputFiles())
    uris = spark.createDataFrame([("urn:r:nation/1",)], "uri string")
    assert key(pub.about(uris).collect()) == key(pub.frame().where("s = 'urn:r:nation/1'").collect())


def test_a_row_with_its_text_does_not_bring_it_twice(spark):
    """pipeline, language"""
    from pyspark.sql import types as T

    from quadsync.llm.language import identify

    docs = spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de"), (3, None, "en"), (4, "", None), (5, "the dog", None)], "doc_id long, text string, lang string")
    whole = identify(docs, docs, F.struct("doc_id", "text"), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    ids = identify(docs, docs, F.col("doc_id"), T.LongType())
    assert sorted(whole.select("row.doc_id", "lang_pred", "score").collect()) == sorted(ids.select("row", "lang_pred", "score").collect())
    tree = whole._jdf.queryExecution().analyzed().toString()
    fed = [x for x in tree.splitlines() if "Project [struct(" in x]
    assert fed and all(", text#" not in x.split(" AS row")[-1] for x in fed)
