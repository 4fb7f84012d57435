from quadsync.operators.export import current, expected
from quadsync.operators.feed import read_delta_files
from quadsync.plans.heal import heal, heal_diff, heal_diff_bag, publication_orphans, run_healing
from quadsync.sources.rules import ExportRule, ExportSpec
from quadsync.vocab import RDF_TYPE, TRIPLE_COLS

T = RDF_TYPE
SCHEME = "urn:r:scheme"
PUBG = "urn:g:publication"


def spec(**kw):
    rules = (
        ExportRule(0, "urn:t:Org", ("urn:p:name",), ("urn:p:in",)),
        ExportRule(1, "urn:t:Person", ("urn:p:name", "^urn:p:member"), ("urn:p:worksFor", "urn:p:in")),
    )
    return ExportSpec(rules=rules, concept_scheme=SCHEME, **kw)


BASE = [
    ("urn:g:a", "urn:r:o1", T, "urn:t:Org"), ("urn:g:a", "urn:r:o1", "urn:p:name", "Org 1"),
    ("urn:g:a", "urn:r:o1", "urn:p:in", SCHEME),
    ("urn:g:a", "urn:r:o2", T, "urn:t:Org"), ("urn:g:a", "urn:r:o2", "urn:p:name", "Org 2"),
    ("urn:g:b", "urn:r:p1", T, "urn:t:Person"), ("urn:g:b", "urn:r:p1", "urn:p:name", "Ann"),
    ("urn:g:b", "urn:r:p1", "urn:p:worksFor", "urn:r:o1"),
    ("urn:g:b", "urn:r:team", "urn:p:member", "urn:r:p1"),
]


def triples(df):
    return sorted(tuple(r) for r in df.select("s", "p", "o").collect())


def test_expected_scope_and_inverse(spark, mk):
    q = mk(BASE)
    got = triples(expected(q, spec()))
    assert ("urn:r:o2", "urn:p:name", "Org 2") not in got          # no path to the scheme
    assert ("urn:r:p1", "urn:p:name", "Ann") in got
    assert ("urn:r:team", "urn:p:member", "urn:r:p1") not in got   # Q5: healing skips ^p
    got_inv = triples(expected(q, spec(heal_inverse=True)))
    assert ("urn:r:team", "urn:p:member", "urn:r:p1") in got_inv


def test_heal_is_idempotent_and_reports_orphans(spark, mk):
    q = mk(BASE)
    s = spec()
    pub = mk([(PUBG, "urn:r:o2", T, "urn:t:Org"), (PUBG, "urn:r:o2", "urn:p:name", "Org 2"),
              (PUBG, "urn:r:ghost", "urn:p:name", "nobody")]).drop("g")
    diff, after = heal(q, pub, s)
    ops = {(r.op, r.s, r.p) for r in diff.collect()}
    assert ("delete", "urn:r:o2", "urn:p:name") in ops
    assert ("insert", "urn:r:p1", "urn:p:name") in ops
    assert heal_diff(q, after, s).count() == 0
    assert triples(publication_orphans(after, s)) == [("urn:r:ghost", "urn:p:name", "nobody")]  # Q12


def test_strict_type_and_graph_filters(spark, mk):
    rows = BASE + [("urn:g:b", "urn:r:p1", T, "urn:t:Extra")]
    q = mk(rows)
    strict = ExportSpec(rules=(ExportRule(1, "urn:t:Person", ("urn:p:name",), ("urn:p:worksFor", "urn:p:in"),
                                          strict=True), ExportRule(0, "urn:t:Org", ("urn:p:name",), ("urn:p:in",))),
                        concept_scheme=SCHEME)
    types = [o for s, p, o in triples(expected(q, strict)) if s == "urn:r:p1" and p == T]
    assert types == ["urn:t:Person"]
    # Q13: a foreign type published earlier is removed under a strict rule
    pub = mk([(PUBG, "urn:r:p1", T, "urn:t:Person"), (PUBG, "urn:r:p1", T, "urn:t:Extra")]).drop("g")
    dels = {r.o for r in heal_diff(q, pub, strict).where("op = 'delete'").collect()}
    assert dels == {"urn:t:Extra"}
    # A regex that also matches the publication graph, unanchored
    rx = ExportSpec(rules=(ExportRule(0, "urn:t:Org", ("urn:p:name",), ("urn:p:in",), graphs=("g:a",),
                                      graphs_regex=True),), concept_scheme=SCHEME)
    assert ("urn:r:o1", "urn:p:name", "Org 1") in triples(expected(q, rx))
    allow = ExportSpec(rules=(ExportRule(0, "urn:t:Org", ("urn:p:name",), ("urn:p:in",), graphs=("urn:g:zzz",)),),
                       concept_scheme=SCHEME)
    assert expected(q, allow).count() == 0


def test_type_in_other_graph_q22(spark, mk):
    # the type sits in a graph the rule does not allow: the other triples are
    # exported without a type, and healing inserts them again every time
    rows = [("urn:g:t", "urn:r:o1", T, "urn:t:Org"), ("urn:g:a", "urn:r:o1", "urn:p:name", "Org 1"),
            ("urn:g:a", "urn:r:o1", "urn:p:in", SCHEME)]
    s = ExportSpec(rules=(ExportRule(0, "urn:t:Org", ("urn:p:name",), ("urn:p:in",), graphs=("urn:g:a",)),),
                   concept_scheme=SCHEME)
    q = mk(rows)
    _, after = heal(q, mk([]).drop("g"), s)
    assert heal_diff(q, after, s).count() == 1
    assert current(after, s).count() == 0


def test_publication_in_store_q1(spark, mk):
    # a link removed from the source but still published keeps the resource in scope
    rows = [r for r in BASE if r[2] != "urn:p:worksFor"]
    pub = mk([(PUBG, "urn:r:p1", "urn:p:worksFor", "urn:r:o1")]).drop("g")
    from quadsync.plans.heal import source_view
    s = spec(pub_in_store=True)
    got = triples(expected(source_view(mk(rows), pub, s), s))
    assert ("urn:r:p1", "urn:p:name", "Ann") in got
    assert ("urn:r:p1", "urn:p:name", "Ann") not in triples(expected(mk(rows), spec()))
    assert set(TRIPLE_COLS) <= set(expected(mk(rows), spec()).columns)


def test_healing_writes_report_and_delta_files(spark, mk, tmp_path):
    q, s = mk(BASE), spec()
    pub = mk([(PUBG, "urn:r:o2", T, "urn:t:Org"), (PUBG, "urn:r:o2", "urn:p:name", "Org 2")]).drop("g")
    out = str(tmp_path)
    after, manifest = run_healing(q, pub, s, out, "r1", "2024-01-01 00:00:00")
    diff = {(r.op, r.s, r.p, r.o) for r in heal_diff(q, pub, s).collect()}
    files = read_delta_files(spark, f"{out}/files").collect()
    assert {(r.op, r.s, r.p, r.o) for r in files} == diff
    assert max(r.slot for r in files if r.op == "delete") < min(r.slot for r in files if r.op == "insert")
    assert {r.kind for r in manifest.collect()} == {"virtual", "physical"}
    assert spark.read.parquet(f"{out}/report/run=r1/removed").count() == 2
    assert all(r.nt.endswith(".") and not r.nt.endswith(" .") for r in spark.read.parquet(f"{out}/report/run=r1/inserted").collect())
    # an initial sync publishes no files; without differences the report is there and empty
    _, none = run_healing(q, after, s, out, "r2", "2024-01-01 00:00:00", publish=False)
    assert none is None and spark.read.parquet(f"{out}/report/run=r2/removed").count() == 0


def test_bag_diff_keeps_surplus_rows(spark, mk):
    q = mk([*BASE, ("urn:g:c", "urn:r:o1", "urn:p:name", "Org 1")])
    pub = mk([(PUBG, "urn:r:o1", T, "urn:t:Org"), (PUBG, "urn:r:o1", "urn:p:name", "Org 1")]).drop("g")
    got = [(r.op, r.p) for r in heal_diff_bag(q, pub, spec()).where("s = 'urn:r:o1'").collect()]
    assert got == [("insert", "urn:p:name")]
