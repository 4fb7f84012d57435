import pytest
from pyspark.sql import functions as F

from quadsync.functions.terms import (
    canonical_object, date_of_instant, decode_literal, escape_predicate, is_inverse, normalize_predicate, ntriple, share_uri, utc_wall,
)
from quadsync.sources.rules import condition_sql, read_config, rule_violations, spec_from_frame
from quadsync.vocab import XSD_DATETIME, XSD_DECIMAL, XSD_INTEGER


def test_ntriple_escapes_and_tags(spark):
    df = spark.createDataFrame([
        ("urn:a", "urn:p", 'say "hi"\\\n', "literal", "", "en"),
        ("urn:a", "urn:p", "5", "literal", XSD_INTEGER, ""),
        ("urn:a", "urn:p", "urn:b", "uri", "", ""),
    ], "s string, p string, o string, o_kind string, o_dt string, o_lang string")
    got = sorted(r[0] for r in df.select(ntriple()).collect())
    assert got == sorted([
        '<urn:a> <urn:p> "say \\"hi\\"\\\\\\n"@en.',
        f'<urn:a> <urn:p> "5"^^<{XSD_INTEGER}>.',
        "<urn:a> <urn:p> <urn:b>.",
    ])
    assert spark.range(1).select(escape_predicate(F.lit("^urn:x"))).first()[0] == "^<urn:x>"


def test_canonical_object_logical_equality(spark):
    rows = [("007", XSD_INTEGER), ("+7", XSD_INTEGER), ("12.50", XSD_DECIMAL), ("12.5", XSD_DECIMAL),
            ("100.00", XSD_DECIMAL), ("2021-05-04T00:00:00Z", XSD_DATETIME),
            ("2021-05-04T00:00:00.000Z", XSD_DATETIME)]
    df = spark.createDataFrame([(o, "literal", dt) for o, dt in rows], "o string, o_kind string, o_dt string")
    keys = [r[0] for r in df.select(canonical_object()).collect()]
    assert keys[0] == keys[1] == "7"
    assert keys[2] == keys[3] == "12.5"
    assert keys[4] == "100"
    assert keys[5] == keys[6]


def keys(spark, rows):
    df = spark.createDataFrame([(o, "literal", dt) for o, dt in rows], "o string, o_kind string, o_dt string")
    return [r[0] for r in df.select(canonical_object()).collect()]


def test_canonical_numbers_are_exact_at_any_length(spark):
    got = keys(spark, [("0.1234567890123", XSD_DECIMAL), ("0.1234567890124", XSD_DECIMAL), ("1.5", XSD_INTEGER), ("1" + "0" * 60, XSD_DECIMAL), ("1" + "0" * 60 + ".0", XSD_DECIMAL),
                       ("-0.0", XSD_DECIMAL), ("+00", XSD_INTEGER), ("-007", XSD_INTEGER), (".5", XSD_DECIMAL), ("0.50", XSD_DECIMAL), ("5.", XSD_DECIMAL), ("abc", XSD_DECIMAL), ("", XSD_INTEGER)])
    assert got[0] != got[1] and got[2] == "1.5" and got[3] == got[4] == "1" + "0" * 60
    assert got[5:] == ["0", "0", "-7", "0.5", "0.5", "5", "abc", ""]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = keys(spark, [("2021-05-04T00:00:00Z", XSD_DATETIME), ("2021-05-04T00:00:00", XSD_DATETIME), ("2021-05-04T02:00:00+02:00", XSD_DATETIME), ("2021-05-04", XSD_DATETIME),
                           ("2021-03-28T02:30:00.25Z", XSD_DATETIME), ("never", XSD_DATETIME)])
        assert got[:4] == ["2021-05-04T00:00:00.000000"] * 4 and got[4:] == ["2021-03-28T02:30:00.250000", "never"]
        day = spark.createDataFrame([("2021-05-04T23:30:00Z",)], "o string").select(date_of_instant(utc_wall(F.col("o").cast("timestamp")))).first()[0]
        assert day == "2021-05-04"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_small_term_helpers(spark):
    row = spark.range(1).select(is_inverse(F.lit("^urn:x")), is_inverse(F.lit("urn:x")), normalize_predicate(F.lit("^urn:x")), share_uri(F.lit("/share/a/b.json")),
                                *decode_literal(F.lit("12"), F.lit(XSD_INTEGER))).first()
    assert tuple(row) == (True, False, "urn:x", "share://a/b.json", 12, None)


def test_rule_violations(spark, tmp_path):
    cfg = tmp_path / "cfg.json"
    cfg.write_text('{"stream": "s1", "conceptScheme": null, "export": ['
                   '{"type": "urn:t:A", "properties": ["urn:p:x"], "pathToConceptScheme": ["urn:p:y"]},'
                   '{"type": "urn:t:B", "properties": []},'
                   '{"properties": ["urn:p:z"]}]}')
    rules = read_config(spark, str(cfg))
    got = sorted((r.rule_no, r.violation) for r in rule_violations(rules).collect())
    assert got == [(0, "path without concept scheme"), (1, "no properties"), (2, "no type")]


def test_conditions_of_a_configuration(spark, tmp_path):
    cfg = tmp_path / "cfg.json"
    cfg.write_text('{"conceptScheme": null, "export": ['
                   '{"type": "urn:t:A", "properties": ["urn:p:x"], "filters": [{"predicate": "urn:p:n", "compare": "contains", "value": "it\'s \\\\ x"}]},'
                   '{"type": "urn:t:B", "properties": ["urn:p:x"], "additionalFilter": "?subject <urn:p:x> ?o"},'
                   '{"type": "urn:t:C", "properties": ["urn:p:x"], "filters": [{"predicate": "urn:p:n", "compare": "like", "value": "x"}]},'
                   f'{{"type": "urn:t:D", "properties": ["urn:p:x"], "filters": [{{"predicate": "urn:p:n", "compare": "<", "value": "x", "datatype": "{XSD_DECIMAL}"}}]}}]}}')
    rules = read_config(spark, str(cfg))
    got = sorted((r.rule_no, r.violation) for r in rule_violations(rules).collect())
    assert got == [(1, "filter is text: give its conditions as filters"), (2, "unknown condition in filters"), (3, "unknown condition in filters")]
    (pattern,) = spec_from_frame(rules.where("rule_no = 0")).rules[0].filter_patterns
    assert pattern[0] == "urn:p:n"
    hits = spark.createDataFrame([("it's \\ x!",), ("its x",)], "o string").where(pattern[1]).collect()
    assert [r.o for r in hits] == ["it's \\ x!"]
    numbers = spark.createDataFrame([("10",), ("9.5",), ("x",)], "o string")
    assert [r.o for r in numbers.where(condition_sql(">=", "9.75", XSD_DECIMAL)).collect()] == ["10"]
