"""What a row per subject or a key does instead of a row per triple or a text."""

import pytest
from pyspark.sql import functions as F

from quadsync.functions.terms import canonical_object, ntriple
from quadsync.operators.diff import apply_patch, effective_changes
from quadsync.operators.export import export_resources
from quadsync.operators.prefix import positions
from quadsync.plans.catalog import _respelled
from quadsync.plans.live import net_changes
from quadsync.session import cut_lineage
from quadsync.sources.fixtures import base_spec
from quadsync.sources.indexed import BucketFolder
from quadsync.sources.packed import CHANGED_COLS, SHORT_COLS, SubjectChanges, SubjectRows, distinct_triples, in_short
from quadsync.sources.tables import quad_store, quads_from_tables
from quadsync.vocab import QUAD_COLS, TRIPLE_COLS, XSD_DATETIME, XSD_DECIMAL, XSD_INTEGER
from tests.test_subject_rows import key
from tests.test_table_source import tables  # noqa: F401


def test_positions_keep_no_partition_in_a_window(spark):
    """a window over the rows kept all of a partition and opened a file for every few thousand."""
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("k"), F.xxhash64("id").cast("string")).alias("k"))
    out = positions(rows, ["g"], ["k"], "n")
    windows = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "Window [" in x]
    assert len(windows) == 1 and "_sum" in windows[0]
    got = sorted((r["g"], r["k"], r["n"]) for r in out.collect())
    keys = {g: sorted(r["k"] for r in rows.where(F.col("g") == g).collect()) for g in range(3)}
    assert got == [(g, k, i) for g in range(3) for i, k in enumerate(keys[g])]


@pytest.mark.parametrize("text, dt, want", [
    ("+0120.500", XSD_DECIMAL, "120.5"), ("-0.00", XSD_DECIMAL, "0"), ("-.50", XSD_DECIMAL, "-0.5"), ("5.", XSD_DECIMAL, "5"), ("1.50\n", XSD_DECIMAL, "1.5"),
    ("+-1", XSD_DECIMAL, "+-1"), ("1.2.3", XSD_DECIMAL, "1.2.3"), ("", XSD_INTEGER, ""), ("-007", XSD_INTEGER, "-7"), ("000", XSD_INTEGER, "0"),
    ("2024-01-02", XSD_DATETIME, "2024-01-02T00:00:00.000000"), ("2024-01-02T03:04:05.000Z", XSD_DATETIME, "2024-01-02T03:04:05.000000"),
    ("2024-01-02T03:04:05+01:00", XSD_DATETIME, "2024-01-02T02:04:05.000000"), ("2024-13-02T03:04:05Z", XSD_DATETIME, "2024-13-02T03:04:05Z"), ("Z", XSD_DATETIME, "Z")])
def test_keys_of_other_spellings(spark, text, dt, want):
    """the same keys, read once."""
    row = spark.createDataFrame([(text, "literal", dt)], "o string, o_kind string, o_dt string")
    assert row.select(canonical_object().alias("k")).first()["k"] == want


def test_changes_meet_a_row_per_subject(spark, tables, monkeypatch):  # noqa: F811
    """publication and changes were moved, told apart and joined triple by triple in full."""
    pub, ch = _respelled(spark, tables)
    assert isinstance(pub, SubjectRows) and isinstance(ch, SubjectChanges)
    literals = quads_from_tables(spark, tables).where(F.col("o_dt").isin(XSD_INTEGER, XSD_DECIMAL, XSD_DATETIME)).select(*QUAD_COLS[1:]).distinct()
    assert key(pub.frame(), *QUAD_COLS[1:]) == key(literals, *QUAD_COLS[1:]) != []
    # a part of the subjects, a term that is no column's, a key that is missing
    some = cut_lineage(pub.frame().where("pmod(hash(s, p), 5) < 3"))
    rows = SubjectRows.of(some.select("s", in_short(F.struct(*QUAD_COLS[2:])).alias("x")).select("s", "x.*").distinct()).kept()
    more = [("urn:r:x/1", "insert", [(None, None, None, None, ("urn:x", "y", "literal", "", "", "y"))]), (None, "delete", [(0, "Line", "urn:t:Line", "", None)])]
    changes = SubjectChanges(ch.df.unionByName(spark.createDataFrame(more, ch.df.schema))).kept()
    assert ch.df.schema["terms"].dataType.elementType.names == CHANGED_COLS and rows.df.schema["terms"].dataType.elementType.names == SHORT_COLS
    plain = changes.frame()
    cols = ["op", *QUAD_COLS[1:]]
    assert key(effective_changes(changes, rows).frame(), *cols) == key(effective_changes(plain, some), *cols) != []
    net = net_changes(changes, rows)
    assert key(net.frame(), *cols) == key(net_changes(plain, some), *cols) != []
    assert key(apply_patch(rows, net), *QUAD_COLS[1:]) == key(apply_patch(some, net_changes(plain, some)), *QUAD_COLS[1:]) != []


def test_lines_are_told_apart_at_their_key(spark, tables):  # noqa: F811
    """every line of text was moved."""
    out = distinct_triples(quad_store(spark, tables)).select(ntriple().alias("nt"))
    assert key(out) == key(quads_from_tables(spark, tables).select(ntriple().alias("nt")).distinct()) != []
    moved = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "Key#" in x.split("hashpartitioning(")[1].replace("key#", "Key#")]
    assert not any("urn:" in x or "nt#" in x for x in moved) and len(moved) >= 7


def test_only_rows_asked_for_are_read(spark, tables):  # noqa: F811
    """An export of some resources made terms of all rows of all tables."""
    spec, quads = base_spec(), quad_store(spark, tables)
    some = cut_lineage(spark.createDataFrame([("urn:r:customer/1", 1), ("urn:r:customer/01", 1), ("urn:r:order/7", 2), ("urn:r:order/7-1", 2), ("urn:r:none/1", 1), (None, 1)], "uri string, rule_no int"))
    frame = cut_lineage(quads_from_tables(spark, tables))
    out = export_resources(some, quads, spec)
    assert key(out) == key(export_resources(some, frame, spec))
    assert not any("lineitem" in x for x in out.inputFiles())
    every = cut_lineage(frame.where("s LIKE 'urn:r:part/%' OR s LIKE 'urn:r:line/%'").select(F.col("s").alias("uri"), F.when(F.col("s").startswith("urn:r:part"), 4).otherwise(3).alias("rule_no")).distinct())
    assert key(export_resources(every, quads, spec)) == key(export_resources(every, frame, spec)) != []


def test_a_question_for_most_buckets_names_no_bucket(spark, tmp_path):
    """the driver listed and kept a path for each bucket at every question."""
    rows = spark.range(2000).select(F.col("id").cast("string").alias("s"), F.lit("x").alias("o"))
    BucketFolder.write(rows, str(tmp_path), "s", 2000, 100)
    folder = BucketFolder(spark, str(tmp_path), "s", "s string, o string")
    assert len(folder.present) > 10
    assert folder.of(rows.select("s")) is folder.all()
    few = folder.of(rows.where("s = '7'").select("s"))
    assert 0 < few.count() < 2000 and few.where("s = '7'").count() == 1
