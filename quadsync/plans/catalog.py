"""Registered queries: one per operator group of SURVEY §7.3.

Each takes ``(spark, sf_dir)`` and returns a DataFrame whose columns match
the DuckDB oracle in ``quadsync.oracle``. All read the driver tables (or
data Spark derives from them) in full.
"""

from __future__ import annotations

import json
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadsync.operators.diff import apply_patch
from quadsync.operators.export import current, expected, expected_rows, export_triples
from quadsync.operators.scope import reach, scoped_subjects
from quadsync.operators.feed import read_delta_files
from quadsync.plans.heal import heal, heal_diff, heal_diff_bag, publication_orphans, report_counts, run_healing, source_view
from quadsync.sources.fixtures import base_spec, drifted_rows
from quadsync.sources.indexed import having
from quadsync.sources.packed import distinct_triples
from quadsync.sources.rules import ExportSpec, read_config, spec_from_frame
from quadsync.sources.tables import distinct_literals, quad_store, quads_from_tables
from quadsync.vocab import TRIPLE_COLS, XSD_DECIMAL, pred

P = pred


def only(spec: ExportSpec, *rule_nos: int, **changes) -> ExportSpec:
    rules = tuple(replace(r, **changes) if changes else r for r in spec.rules if r.rule_no in rule_nos)
    return replace(spec, rules=rules)


def _triples(df: DataFrame) -> DataFrame:
    return df.select(*TRIPLE_COLS)


def _heal_inputs(spark: SparkSession, sf_dir: str):
    """Base rules, quads, expected set and the drifted publication, which is materialised like
    the stored snapshot it stands for. The expected set is computed once for it and for the healing; both are
    stored by subject and in short."""
    spec = base_spec()
    quads = quad_store(spark, sf_dir)
    a = expected_rows(quads, spec).kept()
    return spec, quads, a, drifted_rows(quads, spec, a).kept()


# ------------------------------------------------------------- sources/scope

def quads_from_tables_q(spark, sf_dir):
    return quads_from_tables(spark, sf_dir).select("g", *TRIPLE_COLS)


def type_scan_by_graph(spark, sf_dir):
    return quad_store(spark, sf_dir).typed_counts()


def rule_property_map(spark, sf_dir):
    """A4 over the data: per configured predicate, its rules and quad count."""
    spec = base_spec()
    rows = {}
    for r in spec.rules:
        for prop in r.all_properties:
            rows.setdefault(prop.lstrip("^"), set()).add(r.rule_no)
    rp = spark.createDataFrame([(p, ",".join(str(x) for x in sorted(v))) for p, v in rows.items()],
                               "p string, rule_nos string")
    quads = having(quad_store(spark, sf_dir), list(rows))
    counts = quads.groupBy("p").agg(F.count(F.lit(1)).alias("n_quads"))
    return F.broadcast(rp).join(counts, "p", "left").select("p", "rule_nos", F.coalesce("n_quads", F.lit(0)).alias("n_quads"))


def path_scope_forward(spark, sf_dir):
    spec = only(base_spec(), 3)
    return reach(quad_store(spark, sf_dir), spec)[spec.rules[0].path].select("node")


def path_scope_inverse(spark, sf_dir):
    spec = only(base_spec(), 4)
    return reach(quad_store(spark, sf_dir), spec)[spec.rules[0].path].select("node")


def graph_exclude_publication(spark, sf_dir):
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    store = source_view(quads, pub, replace(spec, pub_in_store=True))
    return _triples(expected(store, replace(spec, pub_in_store=True)))


def graph_allow_list(spark, sf_dir):
    return _triples(expected(quad_store(spark, sf_dir), only(base_spec(), 2)))


def graph_regex_filter(spark, sf_dir):
    return _triples(expected(quad_store(spark, sf_dir), only(base_spec(), 5, filter_patterns=())))


def strict_type_export(spark, sf_dir):
    return _triples(expected(quad_store(spark, sf_dir), only(base_spec(), 1)))


def inverse_property_export(spark, sf_dir):
    spec = only(base_spec(), 4)
    quads = quad_store(spark, sf_dir)
    parts = scoped_subjects(quads, spec).withColumnRenamed("s", "uri")
    return _triples(export_triples(parts, quads, spec))


def additional_filter_expr(spark, sf_dir):
    spec = only(base_spec(), 2, filter_patterns=((P("o_totalprice"), "try_cast(o as double) > 200000"),))
    return _triples(expected(quad_store(spark, sf_dir), spec))


def additional_filter_on_triple(spark, sf_dir):
    """P9, expression form: the condition is on the copied triple itself."""
    spec = only(base_spec(), 2, filter_expr=f"p <> '{P('o_totalprice')}' OR try_cast(o as double) > 200000")
    return _triples(expected(quad_store(spark, sf_dir), spec))


def filter_from_config(spark, sf_dir):
    """A rule and its conditions read from a JSON configuration, checked and run."""
    rule = base_spec().rule(2)
    config = {"conceptScheme": base_spec().concept_scheme, "export": [{
        "type": rule.type, "properties": list(rule.properties), "pathToConceptScheme": list(rule.path), "graphsFilter": list(rule.graphs),
        "filters": [{"predicate": P("o_totalprice"), "compare": ">", "value": "200000", "datatype": XSD_DECIMAL}, {"predicate": P("o_orderstatus"), "compare": "exists"}]}]}
    path = _scratch(spark, "config")
    spark.createDataFrame([(json.dumps(config),)], "value string").write.text(path)
    return _triples(expected(quad_store(spark, sf_dir), spec_from_frame(read_config(spark, path))))


def additional_filter_pattern(spark, sf_dir):
    return _triples(expected(quad_store(spark, sf_dir), only(base_spec(), 5)))


# ------------------------------------------------------------------ healing

def expected_publication(spark, sf_dir):
    return _triples(expected(quad_store(spark, sf_dir), base_spec()))


def current_publication(spark, sf_dir):
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    return _triples(current(pub, spec))


def heal_diff_q(spark, sf_dir):
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    return heal_diff(quads, pub, spec, a).select("op", *TRIPLE_COLS)


def heal_diff_bag_q(spark, sf_dir):
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    return heal_diff_bag(quads, pub, spec).select("op", *TRIPLE_COLS)


def heal_report_counts(spark, sf_dir):
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    return report_counts(heal_diff(quads, pub, spec, a))


def publication_orphans_q(spark, sf_dir):
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    return publication_orphans(pub, spec)


def apply_patch_q(spark, sf_dir):
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    diff, after = heal(quads, pub, spec, a)
    return _triples(after)


def heal_report_q(spark, sf_dir):
    """K6: the report as the job writes it, read back."""
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    out = _scratch(spark, "heal")
    run_healing(quads, pub, spec, out, "run-1", "2024-01-01 00:00:00", publish=False, wanted=a)
    parts = [spark.read.parquet(f"{out}/report/run=run-1/{name}").select(F.lit("run-1").alias("run_id"), F.lit(op).alias("op"), "p", "nt")
             for op, name in (("delete", "removed"), ("insert", "inserted"))]
    return parts[0].unionByName(parts[1])


def heal_delta_files(spark, sf_dir):
    """K8: the delta files that healing wrote, read back."""
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    out = _scratch(spark, "heal")
    run_healing(quads, pub, spec, out, "run-1", "2024-01-01 00:00:00", wanted=a)
    return (read_delta_files(spark, f"{out}/files").withColumn("file_no", F.regexp_extract("name", r"-(\d+)\.json$", 1).cast("bigint"))
            .groupBy("file_no", "slot", "op").agg(F.count(F.lit(1)).alias("n_triples")))


def _scratch(spark, name: str) -> str:
    import uuid

    from quadsync.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def heal_idempotent(spark, sf_dir):
    spec, quads, a, pub = _heal_inputs(spark, sf_dir)
    from quadsync.session import keep_rows

    _, after = heal(quads, pub, spec, a)
    second = heal_diff(quads, keep_rows(after), spec, a)
    return second.agg(F.count(F.when(F.col("op") == "insert", 1)).alias("n_inserts"),
                      F.count(F.when(F.col("op") == "delete", 1)).alias("n_deletes"))


QUERIES = {
    "quads_from_tables": quads_from_tables_q,
    "type_scan_by_graph": type_scan_by_graph,
    "rule_property_map": rule_property_map,
    "path_scope_forward": path_scope_forward,
    "path_scope_inverse": path_scope_inverse,
    "graph_exclude_publication": graph_exclude_publication,
    "graph_allow_list": graph_allow_list,
    "graph_regex_filter": graph_regex_filter,
    "strict_type_export": strict_type_export,
    "inverse_property_export": inverse_property_export,
    "additional_filter_expr": additional_filter_expr,
    "additional_filter_pattern": additional_filter_pattern,
    "additional_filter_on_triple": additional_filter_on_triple,
    "filter_from_config": filter_from_config,
    "expected_publication": expected_publication,
    "current_publication": current_publication,
    "heal_diff": heal_diff_q,
    "heal_diff_bag": heal_diff_bag_q,
    "heal_report_counts": heal_report_counts,
    "publication_orphans": publication_orphans_q,
    "apply_patch": apply_patch_q,
    "heal_idempotent": heal_idempotent,
    "heal_report": heal_report_q,
    "heal_delta_files": heal_delta_files,
}


# ---------------------------------------------------------------- live flow

from quadsync.operators.diff import effective_changes, fold_cancel, fold_last  # noqa: E402
from quadsync.operators.live import (  # noqa: E402
    KEYS, TypeLookup, dispatch, enrich, impacted_resources, rewrite_deletes, rewrite_inserts,
)
from quadsync.operators.paths import ReachTable, rests_of  # noqa: E402
from quadsync.plans.live import live_flow, net_changes  # noqa: E402
from quadsync.plans.strict import strict_delta  # noqa: E402
from quadsync.sources.fixtures import (  # noqa: E402
    LiveFixture, RelationFixture, event_changes, link_fixture, live_spec, split_delete_fixture,
)

CHANGE_COLS = ["msg_id", "cs_no", "op", "pos", "event_id", "s", "p", "o", "o_kind"]


def _live(spark, sf_dir):
    fx = LiveFixture(spark, sf_dir)
    tl = TypeLookup(fx.source, fx.pub, fx.batch, fx.spec, KEYS)
    return fx, tl


def explode_changes(spark, sf_dir):
    return event_changes(spark, sf_dir).select(*CHANGE_COLS)


def type_cache(spark, sf_dir):
    fx, tl = _live(spark, sf_dir)
    uris = (fx.batch.select(*KEYS, F.col("s").alias("uri"))
            .unionByName(fx.batch.where(F.col("o_kind") == "uri").select(*KEYS, F.col("o").alias("uri"))))
    return tl.rules(uris).select(*KEYS, "uri", "rule_no").distinct()


def dispatch_streams(spark, sf_dir):
    fx = LiveFixture(spark, sf_dir)
    return dispatch(fx.changes, fx.source, {"base": base_spec(), "live": live_spec()})


def rewrite_inserts_q(spark, sf_dir):
    fx, tl = _live(spark, sf_dir)
    ins, _ = rewrite_inserts(fx.batch, fx.source, tl, fx.spec)
    return ins.select(*KEYS, *TRIPLE_COLS)


def impacted_resources_q(spark, sf_dir):
    fx, tl = _live(spark, sf_dir)
    ins, _ = rewrite_inserts(fx.batch, fx.source, tl, fx.spec)
    return impacted_resources(ins, tl, fx.spec)


def enrich_closure(spark, sf_dir):
    spec = base_spec()
    after, pub, msg = link_fixture(spark, sf_dir)
    tl = TypeLookup(after, pub, msg, spec, KEYS)
    ins, processed = rewrite_inserts(msg, after, tl, spec)
    return _triples(enrich(ins, processed, after, tl, spec)).distinct()


def rewrite_deletes_q(spark, sf_dir):
    fx, tl = _live(spark, sf_dir)
    return rewrite_deletes(fx.batch, fx.source, fx.pub, tl, fx.spec, cascade=False).select(
        *KEYS, *TRIPLE_COLS)


def cascade_deletes(spark, sf_dir):
    spec = base_spec()
    after, pub, msg = split_delete_fixture(spark, sf_dir, spec)
    tl = TypeLookup(after, pub, msg, spec, KEYS)
    return _triples(rewrite_deletes(msg, after, pub, tl, spec)).distinct()


def fold_cancel_q(spark, sf_dir):
    return fold_cancel(event_changes(spark, sf_dir), keys=["msg_id"]).select("msg_id", "op", *TRIPLE_COLS)


def fold_last_write(spark, sf_dir):
    return fold_last(event_changes(spark, sf_dir)).select("op", *TRIPLE_COLS)


def effective_changes_q(spark, sf_dir):
    fx = LiveFixture(spark, sf_dir)
    return effective_changes(fold_cancel(fx.batch, keys=[]), fx.pub_before).select("op", *TRIPLE_COLS)


def live_flow_net(spark, sf_dir):
    fx = LiveFixture(spark, sf_dir)
    net, _ = live_flow(fx.batch, fx.source, fx.pub, fx.spec)
    return net.select("op", *TRIPLE_COLS)


def _path_names(spark, spec):
    _, numbers = rests_of(spec)
    return F.broadcast(spark.createDataFrame([(no, " / ".join(x.rsplit(":", 1)[-1] if not x.startswith("^") else "^" + x.rsplit(":", 1)[-1] for x in path)) for path, no in numbers.items()], "rest int, path string"))


def _reach_rows(spark, table):
    return table.all().join(_path_names(spark, table.spec), "rest").select("path", "node", "n")


def reach_maintained(spark, sf_dir):
    """The supports of all path rests after the event batch, kept up from those before it."""
    fx = LiveFixture(spark, sf_dir)
    table = ReachTable.build(fx.source_before, fx.spec, _scratch(spark, "reach"))
    after, _ = table.update(fx.batch, fx.source_old, fx.source)
    return _reach_rows(spark, after)


def reach_retracted(spark, sf_dir):
    """The changed rows when customers lose their nation: rests of all lengths behind them."""
    fx = RelationFixture(spark, sf_dir, P("c_nationkey"), "delete")
    table = ReachTable.build(fx.before, fx.spec, _scratch(spark, "reach"))
    _, moved = table.update(fx.message, fx.before, fx.after)
    return moved.join(_path_names(spark, fx.spec), "rest").select("path", "node", "was", "now")


def _strict(spark, sf_dir, predicate, op):
    fx = RelationFixture(spark, sf_dir, predicate, op)
    table = ReachTable.build(fx.before, fx.spec, _scratch(spark, "reach"))
    net, _ = strict_delta(fx.message, fx.before, fx.after, fx.pub, fx.spec, table)
    return net.select("op", *TRIPLE_COLS)


def strict_delete(spark, sf_dir):
    """Q3 strict: customers lose their nation; their orders, lines and last parts leave as well."""
    return _strict(spark, sf_dir, P("c_nationkey"), "delete")


def strict_enrich(spark, sf_dir):
    """Q21 strict: orders get their customer and bring their lines and parts."""
    return _strict(spark, sf_dir, P("o_custkey"), "insert")


QUERIES.update({
    "reach_maintained": reach_maintained,
    "reach_retracted": reach_retracted,
    "strict_delete": strict_delete,
    "strict_enrich": strict_enrich,
    "explode_changes": explode_changes,
    "type_cache": type_cache,
    "dispatch_streams": dispatch_streams,
    "rewrite_inserts": rewrite_inserts_q,
    "impacted_resources": impacted_resources_q,
    "enrich_closure": enrich_closure,
    "rewrite_deletes": rewrite_deletes_q,
    "cascade_deletes": cascade_deletes,
    "fold_cancel": fold_cancel_q,
    "fold_last_write": fold_last_write,
    "effective_changes": effective_changes_q,
    "live_flow_net": live_flow_net,
})


# ------------------------------------------------------- feed, terms, control

import datetime as _dt  # noqa: E402

from quadsync.functions.terms import decode_literal, ntriple  # noqa: E402
from quadsync.operators.feed import (  # noqa: E402
    chunk_changes, feed, manifest_rows, page, replay, write_delta_files,
)
from quadsync.operators.gate import BUSY, SCHEDULED, SUCCESS, debounce_errors, gate, healing_signals  # noqa: E402
from quadsync.operators.scope import in_scope  # noqa: E402
from quadsync.sources.tables import read_table  # noqa: E402
from quadsync.vocab import ADMS_STATUS, XSD_DATETIME, XSD_DECIMAL, XSD_INTEGER  # noqa: E402


def _message_chunks(spark, sf_dir):
    folded = fold_cancel(event_changes(spark, sf_dir), keys=["msg_id"])
    return chunk_changes(folded, cs_keys=["msg_id"])


def delta_file_chunks(spark, sf_dir):
    return _message_chunks(spark, sf_dir).groupBy("file_no", "slot", "op").agg(F.count(F.lit(1)).alias("n_triples"))


def delta_file_feed(spark, sf_dir):
    chunks = _message_chunks(spark, sf_dir)
    base = read_table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    # literals from text: independent of the session and system time zones
    start = F.lit(base.isoformat(sep=" ")).cast("timestamp_ntz")
    named = (chunks.select("file_no").distinct()
             .withColumn("created", start + F.make_interval(secs=(F.col("file_no") / F.lit(1000)).cast("decimal(18,6)")))
             .withColumn("day", F.date_format("created", "yyyy-MM-dd"))
             .withColumn("name", F.format_string("delta-b0-%d.json", F.col("file_no"))))
    manifest = manifest_rows(named, "share/deltas", "b0", "urn:r:publisher/default")
    since = F.lit((base + _dt.timedelta(milliseconds=3)).isoformat(sep=" ")).cast("timestamp_ntz")
    return feed(manifest, since).select("name", "created")


def replay_feed(spark, sf_dir):
    """Consumer replay of the delta files of the live batch, written and read back."""
    fx = LiveFixture(spark, sf_dir)
    net, _ = live_flow(fx.batch, fx.source, fx.pub, fx.spec)
    out = _scratch(spark, "feed")
    write_delta_files(chunk_changes(net.withColumn("cs_no", F.lit(0))), out, "b0", "2024-01-01 00:00:00", fx.spec.publication_graph)
    files = read_delta_files(spark, out).withColumn("file_no", F.regexp_extract("name", r"-(\d+)\.json$", 1).cast("bigint"))
    return replay(files, fx.pub_before)


def page_triples(spark, sf_dir):
    from quadsync.session import keep_rows

    return page(keep_rows(_triples(expected(quad_store(spark, sf_dir), base_spec()))), TRIPLE_COLS, 1000, 3)


def ntriples_export(spark, sf_dir):
    return distinct_triples(quad_store(spark, sf_dir)).select(ntriple().alias("nt"))


def decode_literals(spark, sf_dir):
    q = distinct_literals(spark, sf_dir, (XSD_INTEGER, XSD_DATETIME))
    as_int, as_ts = decode_literal()
    return q.select("s", "p", "o", as_int.alias("int_value"), as_ts.alias("ts_value"))


def _respelled(spark, sf_dir):
    """All numbers and times, and their respelled changes: a third deletes, the others inserts."""
    from quadsync.functions.terms import canonical_object
    from quadsync.sources.fixtures import resource_key
    from quadsync.sources.packed import TERMS, SubjectChanges, changed_term
    from quadsync.sources.tables import literal_rows

    # a row per subject; publication and changes are stored: joins read them several times
    pub = literal_rows(spark, sf_dir, (XSD_INTEGER, XSD_DECIMAL, XSD_DATETIME)).kept()

    def respelled(x):
        """The text of another spelling and the key it has, by the datatype of the column's number."""
        of = lambda dt: x["t"].isin([i for i, y in enumerate(TERMS) if y.o_dt == dt])
        alts = [(XSD_DATETIME, F.concat(x["v"], F.lit(".000Z"))), (XSD_INTEGER, F.concat(F.lit("+0"), x["v"])),
                (XSD_DECIMAL, F.concat(F.lit("+0"), x["v"], F.lit("0")))]
        v = reduce(lambda e, a: F.when(of(a[0]), a[1]).otherwise(e), alts, F.lit(None).cast("string"))
        k = reduce(lambda e, a: F.when(of(a[0]), canonical_object(a[1], F.lit("literal"), F.lit(a[0]))).otherwise(e), alts, F.lit(None).cast("string"))
        return changed_term(x["t"], v, k, x["lang"], F.lit(None))
    op = F.when(resource_key(F.col("s")) % 3 == 0, F.lit("delete")).otherwise(F.lit("insert"))
    return pub, SubjectChanges(pub.df.select("s", op.alias("op"), F.transform("terms", respelled).alias("terms"))).kept()


def logical_literal_equality(spark, sf_dir):
    """J8 on logical equality: the same values in other spellings."""
    pub, ch = _respelled(spark, sf_dir)
    return effective_changes(ch, pub).frame().select("op", "s", "p", "o")


def logical_delete_applied(spark, sf_dir):
    """Deletes in another spelling remove the published triple."""
    pub, ch = _respelled(spark, sf_dir)
    return _triples(apply_patch(pub, net_changes(ch, pub)))


def job_events_fixture(spark, sf_dir):
    """FIXTURES §5: initial sync before the first event; a healing job
    scheduled at one third of the time range, busy, done at one half."""
    lo, hi = read_table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    third, half = lo + (hi - lo) // 3, lo + (hi - lo) // 2
    rows = [(lo - _dt.timedelta(hours=1), "job/initial", "initialSync", "success"),
            (third, "job/heal", "healing", "scheduled"),
            (third + _dt.timedelta(seconds=1), "job/heal", "healing", "busy"),
            (half, "job/heal", "healing", "success")]
    return spark.createDataFrame(rows, "ts timestamp_ntz, job_id string, job_operation string, status string")


def gate_messages(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    msgs = (ev.groupBy((F.col("event_id") / 100).cast("bigint").alias("msg_id"))
            .agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")))
    return gate(msgs, job_events_fixture(spark, sf_dir))


def healing_signals_q(spark, sf_dir):
    """Each event is a status change of its own task; a task belongs to the
    job of its user's remainder by 5, jobs 0 and 1 heal."""
    ev = read_table(spark, sf_dir, "events")
    task = F.concat(F.lit("urn:r:task/"), F.col("event_id").cast("string"))
    job = F.concat(F.lit("urn:r:job/"), (F.col("user_id") % 5).cast("string"))
    status = F.when(F.col("event_type") == "purchase", F.lit(SCHEDULED)).otherwise(F.lit("urn:s:busy"))
    changes = ev.select((F.col("event_id") / 100).cast("bigint").alias("msg_id"), F.when(F.col("event_type") == "view", F.lit("delete")).otherwise(F.lit("insert")).alias("op"),
                        task.alias("s"), F.lit(ADMS_STATUS).alias("p"), status.alias("o"))
    jobs = ev.select(job.alias("job"), (F.col("user_id") % 5).alias("k")).distinct().select(
        "job", F.when(F.col("k") == 0, F.lit("healing")).when(F.col("k") == 1, F.lit("initialSync")).otherwise(F.lit("export")).alias("operation"))
    return healing_signals(changes, ev.select(task.alias("task"), job.alias("job")), jobs)


def error_debounce(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    errors = ev.select(F.lit("default").alias("stream"), F.col("event_id").alias("id"), F.col("ts").alias("created"))
    return debounce_errors(errors, gap="5 minutes")


def in_scope_batch(spark, sf_dir):
    spec = only(base_spec(), 1)
    ev = read_table(spark, sf_dir, "events")
    uris = ev.select(F.concat(F.lit("urn:r:customer/"), F.col("user_id").cast("string")).alias("uri")).distinct()
    return in_scope(uris.withColumn("rule_no", F.lit(1)), quad_store(spark, sf_dir), spec)


QUERIES.update({
    "delta_file_chunks": delta_file_chunks,
    "delta_file_feed": delta_file_feed,
    "replay_feed": replay_feed,
    "page_triples": page_triples,
    "ntriples_export": ntriples_export,
    "decode_literals": decode_literals,
    "logical_literal_equality": logical_literal_equality,
    "logical_delete_applied": logical_delete_applied,
    "gate_messages": gate_messages,
    "healing_signals": healing_signals_q,
    "error_debounce": error_debounce,
    "in_scope_batch": in_scope_batch,
})


# ---------------------------------------------------------------- streaming

def _message_lines(changes):
    from quadsync.sources.messages import to_messages

    return to_messages(changes).select("msg_id", F.to_json(F.struct("msg_id", "changesets")).alias("value"), F.to_json("changesets").alias("bare"))


def _put_files(lines, path: str, triggers: int, hi: int, lo: int = 0, files: int = 3):
    """``lines (msg_id, value)`` as ``triggers`` runs of ``files`` files each; yields after each run."""
    step = (hi - lo) // triggers + 1
    for i in range(triggers):
        part = lines.where((F.col("msg_id") >= lo + i * step) & (F.col("msg_id") < lo + (i + 1) * step))
        part.repartitionByRange(files, "msg_id").sortWithinPartitions("msg_id").select("value").write.mode("append").text(path)
        yield i


def _stream_parts(spark, sf_dir, triggers: int):
    """The live batch as message files, ``triggers`` times three, with bad lines."""
    from quadsync.streaming.live_stream import PublicationStore, batch_handler

    fx = LiveFixture(spark, sf_dir)
    root = _scratch(spark, "stream")
    hi = fx.batch.agg(F.max("msg_id")).first()[0]
    bad = spark.createDataFrame([(fx.m0 + i, '{"msg_id": 1, "changesets": [{"inserts": [') for i in range(3)], "msg_id long, value string")
    for _ in _put_files(_message_lines(fx.batch).drop("bare").unionByName(bad), f"{root}/in", triggers, hi, fx.m0):
        pass
    store = PublicationStore(spark, f"{root}/pub", compact_every=2)
    store.start(fx.pub_before)
    return fx, root, store, batch_handler(fx.spec, lambda _b: fx.source, store, f"{root}/out", f"{root}/files", f"{root}/errors", by_own_id=True)


def stream_live_flow(spark, sf_dir):
    """The live batch as one message file, one availableNow micro-batch."""
    from quadsync.streaming.live_stream import start_live_stream

    _, root, _, handler = _stream_parts(spark, sf_dir, 1)
    start_live_stream(spark, f"{root}/in", f"{root}/ckpt", handler).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("op", *TRIPLE_COLS)


def stream_multi_message(spark, sf_dir):
    """The same messages in two triggers leave the same publication."""
    from quadsync.streaming.live_stream import start_live_stream

    _, root, store, handler = _stream_parts(spark, sf_dir, 2)
    start_live_stream(spark, f"{root}/in", f"{root}/ckpt", handler, max_files_per_trigger=3).awaitTermination()
    return _triples(store.current())


def stream_replay(spark, sf_dir):
    """A batch that is run again after its commit leaves its files as they were."""
    fx, root, _, handler = _stream_parts(spark, sf_dir, 1)
    lines = spark.read.text(f"{root}/in").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    handler(lines, 0)
    handler(lines, 0)
    files = read_delta_files(spark, f"{root}/files/files")
    named = spark.read.parquet(f"{root}/files/manifest").where("kind = 'virtual'").select("name").distinct()
    return files.join(named, "name", "left_semi").select("op", *TRIPLE_COLS)


def stream_bad_message(spark, sf_dir):
    """Every tenth message is cut off; it becomes an error, the others are read."""
    from quadsync.sources.messages import parse_messages, to_messages

    lines = to_messages(event_changes(spark, sf_dir)).select("msg_id", F.to_json(F.struct("msg_id", "changesets")).alias("value"))
    cut = F.when(F.col("msg_id") % 10 == 3, F.expr("left(value, length(value) - 5)")).otherwise(F.col("value"))
    parsed = parse_messages(lines.select(cut.alias("value"), F.lit("f").alias("file"), F.lit(0).cast("timestamp").alias("at")))
    sizes = F.aggregate("changesets", F.lit(0), lambda n, c: n + F.size(F.coalesce(c["inserts"], F.array())) + F.size(F.coalesce(c["deletes"], F.array())))
    return (parsed.select(F.col("own_id").alias("msg_id"), F.when(F.col("error").isNull(), sizes).alias("n"), "error")
            .groupBy("msg_id", "error").agg(F.count(F.lit(1)).alias("n_messages"), F.sum("n").alias("n_changes")))


def stream_bare_messages(spark, sf_dir):
    """Every other message a bare array; the file's order is the messages' order."""
    from quadsync.streaming.live_stream import PublicationStore, batch_handler, start_live_stream

    fx = LiveFixture(spark, sf_dir)
    root = _scratch(spark, "stream")
    hi = fx.batch.agg(F.max("msg_id")).first()[0]
    lines = _message_lines(fx.batch).select("msg_id", F.when(F.col("msg_id") % 2 == 0, F.col("bare")).otherwise(F.col("value")).alias("value"))
    for _ in _put_files(lines, f"{root}/in", 1, hi, fx.m0, files=1):
        pass
    store = PublicationStore(spark, f"{root}/pub")
    store.start(fx.pub_before)
    start_live_stream(spark, f"{root}/in", f"{root}/ckpt", batch_handler(fx.spec, lambda _b: fx.source, store, f"{root}/out")).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("op", *TRIPLE_COLS)


def _gate_lines(spark, sf_dir):
    """All event messages; every 350th event also changes a job's status."""
    ev = read_table(spark, sf_dir, "events").where("event_id % 350 = 0")
    r = (F.col("event_id") / 350).cast("bigint") % 6
    job = F.when(r <= 1, F.lit("urn:r:job/initial")).when(r <= 4, F.lit("urn:r:job/heal")).otherwise(F.lit("urn:r:job/export"))
    status = F.when(r.isin(0, 2), F.lit(SCHEDULED)).when(r.isin(3, 5), F.lit(BUSY)).otherwise(F.lit(SUCCESS))
    changes = ev.select((F.col("event_id") / 100).cast("bigint").alias("msg_id"), ((F.col("event_id") % 100) / 10).cast("int").alias("cs_no"), F.lit("insert").alias("op"),
                        ((F.col("event_id") % 10) * 2 + 100).cast("int").alias("pos"), F.lit("urn:g:jobs").alias("g"), job.alias("s"), F.lit(ADMS_STATUS).alias("p"), status.alias("o"),
                        F.lit("uri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    cols = changes.columns
    jobs = spark.createDataFrame([("urn:r:job/initial", "initialSync"), ("urn:r:job/heal", "healing"), ("urn:r:job/export", "export")], "job string, operation string")
    return _message_lines(event_changes(spark, sf_dir).select(*cols).unionByName(changes)).drop("bare"), jobs


def _stream_gate(spark, sf_dir, restart: bool):
    from quadsync.sources.messages import explode_messages, parse_messages
    from quadsync.streaming.live_stream import MessageGate, start_live_stream

    lines, jobs = _gate_lines(spark, sf_dir)
    root = _scratch(spark, "gate")
    hi = read_table(spark, sf_dir, "events").agg(F.max((F.col("event_id") / 100).cast("bigint"))).first()[0]

    def run():
        gate = MessageGate(spark, f"{root}/gate", jobs)

        def handler(some, batch_id):
            messages = parse_messages(some, by_own_id=True).where("error IS NULL")
            gate.admit(messages, explode_messages(messages), batch_id)
        start_live_stream(spark, f"{root}/in", f"{root}/ckpt", handler, max_files_per_trigger=1).awaitTermination()

    for _ in _put_files(lines, f"{root}/in", 4, hi, files=1):
        if restart:
            run()
    if not restart:
        run()
    return spark.read.parquet(f"{root}/gate/decisions").select("msg_id", "decision")


def stream_gate(spark, sf_dir):
    """Four triggers of one run."""
    return _stream_gate(spark, sf_dir, False)


def stream_gate_restart(spark, sf_dir):
    """The same, each trigger by a query that was started anew."""
    return _stream_gate(spark, sf_dir, True)


def stream_dispatch(spark, sf_dir):
    """T5: one source, a log per stream, and a query per log; each stream's messages in its own order."""
    from quadsync.sources.messages import parse_messages
    from quadsync.streaming.live_stream import dispatch_handler, start_live_stream

    fx = LiveFixture(spark, sf_dir)
    specs = {"base": base_spec(), "live": live_spec()}
    root = _scratch(spark, "dispatch")
    hi = fx.changes.agg(F.max("msg_id")).first()[0]
    for _ in _put_files(_message_lines(fx.changes).drop("bare"), f"{root}/in", 2, hi):
        pass
    start_live_stream(spark, f"{root}/in", f"{root}/ckpt", dispatch_handler(specs, lambda _b: fx.source, f"{root}/log", by_own_id=True), max_files_per_trigger=3).awaitTermination()

    def take(name):
        def handler(lines, batch_id):
            (parse_messages(lines, by_own_id=True).where("error IS NULL").select(F.lit(name).alias("stream"), "msg_id")
             .write.mode("overwrite").parquet(f"{root}/taken/{name}-{batch_id}"))
        return handler
    running = [start_live_stream(spark, f"{root}/log/{name}/*", f"{root}/ckpt-{name}", take(name)) for name in specs]
    for q in running:
        q.awaitTermination()
    from quadsync.operators.prefix import running_total

    taken = spark.read.parquet(f"{root}/taken/*").withColumn("one", F.lit(1))
    return running_total(taken, ["stream"], ["msg_id"], "one", "place").select("stream", "msg_id", F.col("place").cast("long").alias("place"))


def stream_debounce(spark, sf_dir):
    """K7: the error bursts in a stream of three triggers, each by a query that was started anew."""
    from quadsync.streaming.live_stream import start_debounce_stream

    root = _scratch(spark, "bursts")
    ev = read_table(spark, sf_dir, "events").where(F.col("event_type") == "error")
    errors = ev.select(F.lit("default").alias("stream"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created"))
    lo, hi = errors.agg(F.min("id"), F.max("id")).first()
    step = (hi - lo) // 3 + 1
    parts = [errors.where((F.col("id") >= lo + i * step) & (F.col("id") < lo + (i + 1) * step)) for i in range(3)]
    end = errors.agg(F.max("created").alias("m")).select(F.lit("heartbeat").alias("stream"), F.lit(None).cast("long").alias("id"), (F.col("m") + F.expr("INTERVAL 1 DAY")).alias("created"))
    for part in [*parts, end]:
        part.write.mode("append").parquet(f"{root}/in")
        start_debounce_stream(spark, f"{root}/in", f"{root}/ckpt", f"{root}/out", gap="5 minutes").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select("stream", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "last_id", "n_errors")


QUERIES.update({
    "stream_bare_messages": stream_bare_messages,
    "stream_gate": stream_gate,
    "stream_gate_restart": stream_gate_restart,
    "stream_dispatch": stream_dispatch,
    "stream_debounce": stream_debounce,
    "stream_live_flow": stream_live_flow,
    "stream_multi_message": stream_multi_message,
    "stream_replay": stream_replay,
    "stream_bad_message": stream_bad_message,
})
