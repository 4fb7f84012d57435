"""Lookups by URI, path walks, the maintained reach table and strict changes, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quadsync.operators.diff import apply_patch, snapshot_diff
from quadsync.operators.export import expected
from quadsync.operators.paths import ReachTable, rests_of, walk
from quadsync.plans.strict import strict_delta
from quadsync.sources.indexed import FilteredSource, FrameSource, IndexedQuads, LayeredSource
from quadsync.sources.rules import ExportRule, ExportSpec
from quadsync.vocab import QUAD_COLS, RDF_TYPE, TRIPLE_COLS

SCHEME = "urn:r:top"
RULES = (
    ExportRule(0, "urn:t:A", ("urn:p:name",), ("urn:p:in",)),
    ExportRule(1, "urn:t:B", ("urn:p:name", "urn:p:of"), ("urn:p:of", "urn:p:in"), strict=True),
    ExportRule(2, "urn:t:C", ("urn:p:name",), ("^urn:p:has", "urn:p:of", "urn:p:in"), filter_patterns=(("urn:p:name", "o <> 'n3'"),)),
    ExportRule(3, "urn:t:A", ("urn:p:name", "urn:p:has"), ("urn:p:in", "urn:p:in")),
    ExportRule(4, "urn:t:D", ("urn:p:name",)),
)
SPEC = ExportSpec(rules=RULES, concept_scheme=SCHEME)


def graph(r, n=40):
    """Links among n nodes, cycles and loops included, and to the scheme node."""
    node = lambda: f"urn:r:{r.randrange(n)}"
    links = {(node(), p, node()) for p in ("urn:p:in", "urn:p:of", "urn:p:has") for _ in range(n)}
    return links | {(node(), "urn:p:in", SCHEME) for _ in range(4)}


def things(r, n=40):
    rows = set()
    for i in range(n):
        rows |= {(f"urn:r:{i}", RDF_TYPE, f"urn:t:{t}") for t in "ABCD" if r.random() < 0.5} | {(f"urn:r:{i}", "urn:p:name", f"n{r.randrange(6)}")}
    return rows


def quads(mk, rows, g="urn:g:x"):
    return mk([(g, *x) for x in sorted(rows)])


def supports(links):
    """{(node, path): number of next nodes from which the rest of the path leads to the scheme node}."""
    rests, numbers = rests_of(SPEC)
    out, there = {}, {-1: {SCHEME}}
    for r in rests:
        pairs = {(o, s) if r.inverse else (s, o) for s, p, o in links if p == r.p}
        for node, nxt in pairs:
            if nxt in there[r.then]:
                out[node, r.no] = out.get((node, r.no), 0) + 1
        there[r.no] = {node for node, no in out if no == r.no}
    return out


def test_indexed_quads_answer_like_a_frame(spark, mk, tmp_path):
    r = random.Random(1)
    df = quads(mk, graph(r) | things(r) | {("urn:r:0", "urn:p:in", f"urn:r:hot{i}") for i in range(300)})
    IndexedQuads.write(df, str(tmp_path), bucket_rows=20)
    index, frame = IndexedQuads(spark, str(tmp_path), QUAD_COLS), FrameSource(df)
    assert index.by_s.n > 10 and sorted(index.frame().collect()) == sorted(df.collect())
    for asked in (["urn:r:0", "urn:r:5", "urn:r:nobody"], [], [SCHEME]):
        uris = spark.createDataFrame([(u,) for u in asked], "uri string")
        for predicates in (None, ["urn:p:in"], ["urn:p:none"]):
            assert sorted(index.about(uris, predicates).collect()) == sorted(frame.about(uris, predicates).collect())
            if predicates:
                assert sorted(index.pointing(uris, predicates).collect()) == sorted(frame.pointing(uris, predicates).collect())
    uris = spark.createDataFrame([("urn:r:5",)], "uri string")
    read = index.about(uris).inputFiles()
    assert 0 < len(read) < index.by_s.n / 2  # other buckets are not even listed
    with pytest.raises(ValueError, match="types"):
        index.pointing(uris, [RDF_TYPE])


def test_layers_and_filters(spark, mk):
    base = FrameSource(mk([("g", "urn:a", "urn:p", "1"), ("g", "urn:a", "urn:p", "2"), ("g", "urn:b", "urn:p", "urn:a")]))
    more, gone = mk([("g", "urn:a", "urn:p", "3")]), mk([("g", "urn:a", "urn:p", "1")])
    a = spark.createDataFrame([("urn:a",)], "uri string")
    both = LayeredSource(base, added=more, gone=gone)
    assert sorted(x.o for x in both.about(a).collect()) == ["2", "3"] and both.frame().count() == 3
    only = FilteredSource(both, F.col("o") != "2")
    assert [x.o for x in only.about(a).collect()] == ["3"] and [x.s for x in only.pointing(a).collect()] == ["urn:b"]


def test_walk_finds_what_reaches_the_scheme_node(spark, mk):
    r = random.Random(5)
    links = graph(r)
    rests, _ = rests_of(SPEC)
    starts = spark.createDataFrame([(f"urn:r:{i}", x.no) for i in range(40) for x in rests], "node string, rest int")
    got = {(x.node, x.rest) for x in walk(starts, quads(mk, links), SPEC).collect()}
    assert got == set(supports(links))
    assert walk(starts.limit(0), quads(mk, links), SPEC).count() == 0


def test_reach_table_follows_changes(spark, mk, tmp_path):
    r = random.Random(8)
    links = graph(r)
    table = ReachTable.build(quads(mk, links), SPEC, str(tmp_path), bucket_rows=10)
    assert {(x.node, x.rest): x.n for x in table.all().collect()} == supports(links)
    for step in range(3):
        gone, new = set(r.sample(sorted(links), 25)), graph(r, 44) - links
        new = set(r.sample(sorted(new), 20))
        after = (links - gone) | new
        touched = gone | new | set(r.sample(sorted(after), 5))  # some that do not change
        before, later = quads(mk, links), quads(mk, after).unionByName(quads(mk, after, "urn:g:again"))
        was = supports(links)
        table, moved = table.update(quads(mk, touched), before, later)
        now = supports(after)
        assert {(x.node, x.rest): x.n for x in table.all().collect()} == now, step
        changed = {k for k in was.keys() | now.keys() if was.get(k, 0) != now.get(k, 0)}
        assert {(x.node, x.rest): (x.was, x.now) for x in moved.collect()} == {k: (was.get(k, 0), now.get(k, 0)) for k in changed}
        assert spark.read.parquet(f"{tmp_path}/change/v={step + 1}").count() == len(changed)
        links = after


@pytest.mark.parametrize("inverse", [False, True])
def test_strict_changes_equal_a_full_healing(spark, mk, tmp_path, inverse):
    rules = (*RULES, ExportRule(5, "urn:t:D", ("^urn:p:has", "urn:p:name"), ("urn:p:in",)))
    spec = ExportSpec(rules=rules, concept_scheme=SCHEME, heal_inverse=inverse)
    r = random.Random(3)
    rows = graph(r) | things(r)
    gone, new = set(r.sample(sorted(rows), 40)), (graph(r) | things(r)) - rows
    new = set(r.sample(sorted(new), 30))
    before, after = quads(mk, rows), quads(mk, (rows - gone) | new)
    pub, want = expected(before, spec), expected(after, spec)
    table = ReachTable.build(before, spec, str(tmp_path))
    net, _ = strict_delta(quads(mk, gone | new), FrameSource(before), FrameSource(after), FrameSource(pub), spec, table)
    cols = ["op", *TRIPLE_COLS]
    assert sorted(net.select(*cols).collect()) == sorted(snapshot_diff(want, pub).select(*cols).collect())
    assert sorted(apply_patch(pub, net).select(*TRIPLE_COLS).collect()) == sorted(want.select(*TRIPLE_COLS).collect())
