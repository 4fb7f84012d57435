"""Table rows meet resources and publications by subject, by keys and in short."""

import pytest

from quadsync.operators.diff import rows_diff, snapshot_diff
from quadsync.operators.export import current, current_rows, expected, expected_rows, export_resources, export_triples
from quadsync.operators.paths import ReachTable
from quadsync.operators.scope import ScopeIndex, path_index, reach, scoped_subjects
from quadsync.plans.heal import source_view
from quadsync.session import cut_lineage
from quadsync.sources.fixtures import base_spec, drifted_publication, drifted_rows
from quadsync.sources.indexed import LayeredSource
from quadsync.sources.packed import NUMBER, SubjectRows
from quadsync.sources.tables import quad_store, quads_from_tables
from quadsync.vocab import QUAD_COLS, RDF_TYPE, TRIPLE_COLS, pred
from tests.test_table_source import tables  # noqa: F401


def key(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*(columns or sorted(df.columns))).collect())


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_healing_diff_moves_a_row_per_subject(spark, tables):  # noqa: F811
    """published and expected triples were told apart and joined one by one."""
    spec, quads = base_spec(), quad_store(spark, tables)
    a = expected_rows(quads, spec).kept()
    assert key(a.frame(), *TRIPLE_COLS) == key(expected(quads, spec), *TRIPLE_COLS) != []
    more = [("urn:r:ghost/9", [(None, None, None, ("urn:x", "y", "literal", "", "", "y"))]),
            ("urn:r:customer/9", [(NUMBER[RDF_TYPE], "Customer", "", None), (NUMBER[pred("c_name")], "old", "", None)])]
    drifted = drifted_rows(quads, spec, a).df.where("s <> 'urn:r:customer/1'")
    pub = SubjectRows(drifted.unionByName(spark.createDataFrame(more, a.df.schema))).kept()
    assert key(drifted_publication(quads, spec, a.frame()), *TRIPLE_COLS) == key(drifted_rows(quads, spec, a).frame(), *TRIPLE_COLS)
    assert key(current_rows(pub, spec).frame(), *TRIPLE_COLS) == key(current(pub.frame(), spec), *TRIPLE_COLS)
    assert shuffles(current(pub, spec)) == 0
    diff = rows_diff(a, current_rows(pub, spec))
    assert key(diff, "op", *TRIPLE_COLS) == key(snapshot_diff(a.frame(), current(pub.frame(), spec)), "op", *TRIPLE_COLS) != []


@pytest.mark.parametrize("inverse_too", [False, True])
def test_resources_meet_table_rows_in_one_join(spark, tables, inverse_too):  # noqa: F811
    """rows were looked up, written, joined again and told apart twice in full."""
    spec, quads = base_spec(), quad_store(spark, tables)
    if inverse_too:  # a predicate that is exported both ways
        from dataclasses import replace
        spec = replace(spec, rules=tuple(replace(r, properties=(*r.properties, "^" + pred("l_orderkey"))) if r.rule_no == 2 else r for r in spec.rules))
    frame = cut_lineage(quads_from_tables(spark, tables))
    uris = cut_lineage(scoped_subjects(quads, spec).withColumnRenamed("s", "uri"))
    assert key(export_resources(uris, quads, spec)) == key(export_resources(uris, frame, spec)) != []
    out = export_triples(uris, quads, spec)
    assert key(out, *TRIPLE_COLS) == key(export_resources(uris, frame, spec).select(*TRIPLE_COLS).distinct(), *TRIPLE_COLS) != []
    answers = [x for x in out._jdf.queryExecution().analyzed().toString().split() if "/cut-" in x]
    assert not answers


@pytest.mark.parametrize("added", [
    [("urn:r:event/1", pred("by"), "urn:r:customer/1"), ("urn:r:order/7", pred("o_custkey"), "urn:r:customer/1"), ("urn:r:line/7-2", pred("l_orderkey"), "urn:r:order/7"), ("urn:r:line/7-2", pred("l_partkey"), "urn:r:part/5")],
    [("urn:r:order/07", pred("o_custkey"), "urn:r:customer/1"), ("urn:r:line/7", pred("l_orderkey"), "urn:r:order/07")],
])
def test_paths_over_added_links_are_found_by_keys(spark, tables, mk, added):  # noqa: F811
    """With anything added, all links were told apart and joined as text; a URI that no table spells still is."""
    spec = base_spec()
    more = mk([("urn:g:x", *t) for t in added])
    layered = LayeredSource(quad_store(spark, tables), added=more)
    frame = cut_lineage(quads_from_tables(spark, tables).unionByName(more.select(*QUAD_COLS)))
    ours, theirs = reach(layered, spec), reach(frame, spec)
    assert {p: key(x.where("node IS NOT NULL")) for p, x in ours.items()} == {p: key(x.where("node IS NOT NULL")) for p, x in theirs.items()}
    assert isinstance(path_index(layered, spec), ScopeIndex)
    if len(added) == 2:
        return
    assert key(expected(layered, spec)) == key(expected(frame, spec))
    tables_ = [ReachTable.build(x, spec, f"{spark.conf.get('spark.checkpoint.dir')}/reach-{len(added)}-{i}").all() for i, x in enumerate((layered, frame))]
    assert key(tables_[0].where("node IS NOT NULL")) == key(tables_[1].where("node IS NOT NULL")) != []


def test_what_no_rule_may_copy_is_not_moved(spark, tables):  # noqa: F811
    """the publication in the store was moved to the subjects in scope and dropped there."""
    from dataclasses import replace
    spec = replace(base_spec(), pub_in_store=True)
    quads = quad_store(spark, tables)
    a = expected_rows(quads, spec).kept()
    pub = drifted_rows(quads, spec, a).kept()
    store = source_view(quads, pub, spec)
    assert key(expected(store, spec), *TRIPLE_COLS) == key(expected(store.frame(), spec), *TRIPLE_COLS) != []
