"""Healing and initial sync.

One batch job: expected set A (all rules at once), current set B, one
full-outer diff, then the patch is applied as a new publication version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadsync.functions.terms import ntriple
from quadsync.operators.diff import apply_patch, bag_diff, rows_diff, snapshot_diff
from quadsync.operators.export import current, current_rows, expected
from quadsync.operators.feed import chunk_changes, write_delta_files
from quadsync.session import keep_rows
from quadsync.sources.indexed import LayeredSource
from quadsync.sources.packed import SubjectRows
from quadsync.sources.rules import ExportSpec
from quadsync.vocab import LEXICAL_KEY, TRIPLE_COLS


def source_view(quads, publication: DataFrame, spec: ExportSpec):
    """Q1: with ``pub_in_store`` the publication rows are part of the store."""
    if not spec.pub_in_store:
        return quads
    pub = _frame(publication).select(F.lit(spec.publication_graph).alias("g"), *TRIPLE_COLS, "o_key")
    return quads.unionByName(pub) if isinstance(quads, DataFrame) else LayeredSource(quads, added=pub)


def heal_diff(quads, publication: DataFrame, spec: ExportSpec, wanted: DataFrame | None = None) -> DataFrame:
    """R7 diff: ``(op, s, p, o, o_kind, o_dt, o_lang, o_key)``; ``wanted`` is the expected set, if it is at hand."""
    if isinstance(publication, SubjectRows) and isinstance(wanted, SubjectRows) and not (spec.heal_inverse and spec.inverse_properties()):
        return rows_diff(wanted, current_rows(publication, spec))
    a = expected(source_view(quads, publication, spec), spec) if wanted is None else _frame(wanted)
    return snapshot_diff(a, current(publication, spec))


def _frame(triples) -> DataFrame:
    return triples.frame() if isinstance(triples, SubjectRows) else triples


def heal_diff_bag(quads, publication: DataFrame, spec: ExportSpec) -> DataFrame:
    """Q14 file variant: bag difference on the full rows."""
    a = expected(source_view(quads, publication, spec), spec, bag=True)
    b = current(publication, spec)
    return bag_diff(a, b)


def heal(quads, publication: DataFrame, spec: ExportSpec, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(diff, publication after the patch); the diff is written once for all its uses."""
    diff = keep_rows(heal_diff(quads, publication, spec, wanted))
    return diff, apply_patch(_frame(publication), diff)


def heal_changesets(diff: DataFrame) -> DataFrame:
    """K8: the patch as delta file chunks: one changeset of all deletes, then one
    of all inserts."""
    cs = F.when(F.col("op") == "delete", F.lit(0)).otherwise(F.lit(1))
    return chunk_changes(diff.select(cs.alias("cs_no"), "op", *TRIPLE_COLS))


def heal_report(diff: DataFrame, run_id: str) -> DataFrame:
    """K6: ``(run_id, op, p, nt)``, the removed and inserted triples as N-Triples."""
    return diff.select(F.lit(run_id).alias("run_id"), "op", "p", ntriple().alias("nt"))


def run_healing(quads, publication: DataFrame, spec: ExportSpec, out_dir: str, run_id: str, created, publish: bool = True, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Heal, write the report (both folders, also when empty) and,
    unless it is an initial sync (``publish=False``), the delta files. Returns
    (publication after, manifest rows of the files)."""
    diff, after = heal(quads, publication, spec, wanted)
    report = heal_report(diff, run_id)
    for op, name in (("delete", "removed"), ("insert", "inserted")):
        report.where(F.col("op") == op).select("p", "nt").write.mode("overwrite").parquet(f"{out_dir}/report/run={run_id}/{name}")
    manifest = None
    if publish:
        manifest = write_delta_files(heal_changesets(diff), f"{out_dir}/files", run_id, created, spec.publication_graph)
        manifest.write.mode("overwrite").parquet(f"{out_dir}/manifest/run={run_id}")
    return after, manifest


def report_counts(diff: DataFrame) -> DataFrame:
    """K6 counts: triples removed/inserted per predicate."""
    return diff.groupBy("op", "p").agg(F.count(F.lit(1)).alias("n_triples"))


def publication_orphans(publication: DataFrame, spec: ExportSpec) -> DataFrame:
    """Q12: published triples the healing never sees (untyped subjects or
    unconfigured properties); reported, not deleted."""
    seen = current(publication, spec)
    return _frame(publication).select(*TRIPLE_COLS).distinct().join(seen.select(*LEXICAL_KEY), LEXICAL_KEY, "left_anti")
