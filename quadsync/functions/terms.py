"""Term helpers as Catalyst expressions.

Everything here returns a ``Column`` so it stays inside whole-stage
codegen; nothing is evaluated row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadsync.vocab import XSD_BOOLEAN, XSD_DATETIME, XSD_DECIMAL, XSD_INTEGER


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_inverse(p) -> Column:
    """H1: a configured property ``^p`` walks the relation backwards."""
    return _c(p).startswith("^")


def normalize_predicate(p) -> Column:
    """H2: strip the leading ``^``."""
    return F.regexp_replace(_c(p), r"^\^", "")


def escape_predicate(p) -> Column:
    """H3: ``<p>`` or ``^<p>``."""
    p = _c(p)
    return F.when(p.startswith("^"), F.concat(F.lit("^<"), F.substring(p, 2, 1 << 30), F.lit(">"))).otherwise(
        F.concat(F.lit("<"), p, F.lit(">"))
    )


def _escape_literal(v: Column) -> Column:
    # N-Triples string escapes: backslash first, then quote, LF, CR.
    v = F.replace(v, F.lit("\\"), F.lit("\\\\"))
    v = F.replace(v, F.lit('"'), F.lit('\\"'))
    v = F.replace(v, F.lit("\n"), F.lit("\\n"))
    return F.replace(v, F.lit("\r"), F.lit("\\r"))


def serialize_term(kind, value, dt, lang) -> Column:
    """H4: one term in N-Triples form."""
    kind, value, dt, lang = _c(kind), _c(value), _c(dt), _c(lang)
    lit = F.concat(F.lit('"'), _escape_literal(value), F.lit('"'))
    return (
        F.when(kind == "uri", F.concat(F.lit("<"), value, F.lit(">")))
        .when(F.coalesce(dt, F.lit("")) != "", F.concat(lit, F.lit("^^<"), dt, F.lit(">")))
        .when(F.coalesce(lang, F.lit("")) != "", F.concat(lit, F.lit("@"), lang))
        .otherwise(lit)
    )


def ntriple(s="s", p="p", o="o", o_kind="o_kind", o_dt="o_dt", o_lang="o_lang") -> Column:
    """H5: ``<s> <p> object.`` (subjects and predicates are URIs)."""
    return F.concat(
        F.lit("<"), _c(s), F.lit("> "), escape_predicate(p), F.lit(" "),
        serialize_term(o_kind, o, o_dt, o_lang), F.lit("."),
    )


def utc_wall(instant) -> Column:
    """An instant as UTC wall time (``timestamp_ntz``), whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(instant)), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def utc_timestamp(o) -> Column:
    """Text of a dateTime -> UTC wall time; text without zone is UTC; null if it is none."""
    o = _c(o)
    zoned = (F.when(o.endswith("Z") & o.contains(":"), o)
             .when((F.length(o) <= 12) & o.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(o, F.lit("T00:00:00Z")))
             .when(o.rlike(r"(Z|[+-]\d\d:?\d\d)$") & o.contains(":"), o).otherwise(F.concat(o, F.lit("Z"))))
    return utc_wall(zoned.try_cast("timestamp"))


def _canonical_number(o: Column, pattern: str) -> Column:
    """Digits without superfluous zeros and sign, of any length; null if the text is no such number."""
    def of_digits(body: Column) -> Column:
        whole = F.ltrim(F.substring_index(body, ".", 1), F.lit("0"))
        part = F.when(body.contains("."), F.rtrim(F.substring_index(body, ".", -1), F.lit("0"))).otherwise("")
        digits = F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))
        return F.when(o.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    # one pattern decides, the rest is cut off text; `$` also stands before a last line end
    body = F.when(o.startswith("+") | o.startswith("-"), F.substring(o, 2, 1 << 30)).otherwise(o)
    signed = lambda x: F.transform(F.array(x), of_digits)[0]
    return (F.when(o.rlike(pattern.replace("$", r"\z")), signed(body))
            .when(o.rlike(pattern), signed(F.rtrim(body, F.lit("\n\r\u0085\u2028\u2029")))))


def canonical_object(o="o", o_kind="o_kind", o_dt="o_dt") -> Column:
    """Canonical text of an object for logical equality (``o_key``).

    integer and decimal: no plus sign, no superfluous zeros (text only, so any
    length and precision is exact); dateTime: UTC with microseconds; boolean:
    true/false; anything else, also text that is no such value: lexical.
    """
    o, kind, dt = _c(o), _c(o_kind), _c(o_dt)
    def of_stamp(stamp: Column) -> Column:
        micros = F.rpad(F.regexp_extract(stamp, r"\.([0-9]+)$", 1), 6, "0")
        return F.concat(F.substring(stamp, 1, 10), F.lit("T"), F.substring(stamp, 12, 8), F.lit("."), micros)
    as_ts = F.transform(F.array(utc_timestamp(o).cast("string")), of_stamp)[0]  # parsed once, used three times
    low = F.lower(o)
    as_bool = F.when(low.isin("true", "1"), F.lit("true")).when(low.isin("false", "0"), F.lit("false"))
    return (
        F.when(kind == "uri", o)
        .when(dt == XSD_INTEGER, F.coalesce(_canonical_number(o, r"^[+-]?[0-9]+$"), o))
        .when(dt == XSD_DECIMAL, F.coalesce(_canonical_number(o, r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), o))
        .when(dt == XSD_DATETIME, F.coalesce(as_ts, o))
        .when(dt == XSD_BOOLEAN, F.coalesce(as_bool, o))
        .otherwise(o)
    )


def decode_literal(o="o", o_dt="o_dt"):
    """H7: typed decode of an object: (integer value, UTC wall time)."""
    o, dt = _c(o), _c(o_dt)
    return (
        F.when(dt == XSD_INTEGER, o.try_cast("bigint")),
        F.when(dt == XSD_DATETIME, utc_timestamp(o)),
    )


def date_of_instant(ts) -> Column:
    """H9: ``yyyy-MM-dd`` of UTC wall time (``utc_wall`` of an instant)."""
    return F.substring(_c(ts).cast("timestamp_ntz").cast("string"), 1, 10)


def share_uri(path, share_root: str = "/share") -> Column:
    """File path -> ``share://`` URI."""
    return F.concat(F.lit("share://"), F.regexp_replace(_c(path), "^" + share_root.rstrip("/") + "/?", ""))
