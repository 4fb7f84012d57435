"""DuckDB oracle SQL for the registered queries.

Independent formulations in plain SQL over the driver's tables (views
``region nation customer ...``). The table-to-quad mapping is rendered from
the same declarative map the Spark side uses (it is input definition,
FIXTURES §2); all operator logic below is written out by hand.
"""

from __future__ import annotations

from quadsync.sources.tables import DEC, LANG, TABLE_MAPS, TS, TableMap
from quadsync.vocab import RDF_TYPE

RDF = f"'{RDF_TYPE}'"
PUB = "'urn:g:publication'"
INT_DT = "'http://www.w3.org/2001/XMLSchema#integer'"
DEC_DT = "'http://www.w3.org/2001/XMLSchema#decimal'"
TS_DT = "'http://www.w3.org/2001/XMLSchema#dateTime'"
DT = {"int": INT_DT, "dec": DEC_DT, "ts": TS_DT, "str": "''", "lang": "''"}


def _subject(m: TableMap) -> str:
    kind, *keys = m.subject
    return f"'urn:r:{kind}/' || " + " || '-' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)


def _graph(m: TableMap) -> str:
    const, col = m.graph
    return f"'urn:g:{const}'" + (f" || CAST({col} AS VARCHAR)" if col else "")


def _text(col: str, kind: str) -> str:
    if kind == DEC:
        return f"CAST(CAST({col} AS DECIMAL(18,2)) AS VARCHAR)"
    if kind == TS:
        return f"strftime({col}, '%Y-%m-%dT%H:%M:%S')"
    return f"CAST({col} AS VARCHAR)"


def _key(text: str, kind: str) -> str:
    if kind == DEC:
        return f"regexp_replace(regexp_replace({text}, '0+$', ''), '\\.$', '')"
    if kind == TS:
        return f"{text} || '.000000'"
    return text


def quads_select() -> str:
    parts = []
    for m in TABLE_MAPS:
        s, g = _subject(m), _graph(m)
        for tname, cond in m.types:
            where = f" WHERE {cond}" if cond else ""
            parts.append(f"SELECT {g} AS g, {s} AS s, {RDF} AS p, 'urn:t:{tname}' AS o, 'uri' AS o_kind, "
                         f"'' AS o_dt, '' AS o_lang, 'urn:t:{tname}' AS o_key FROM {m.table}{where}")
        for col, target in m.links:
            o = f"'urn:r:{target}/' || CAST({col} AS VARCHAR)"
            parts.append(f"SELECT {g}, {s}, 'urn:p:{col}', {o}, 'uri', '', '', {o} FROM {m.table}")
        for col, kind in m.literals:
            t = _text(col, kind)
            lang = f"CAST({m.lang_column} AS VARCHAR)" if kind == LANG else "''"
            parts.append(f"SELECT {g}, {s}, 'urn:p:{col}', {t}, 'literal', {DT[kind]}, {lang}, {_key(t, kind)} "
                         f"FROM {m.table}")
    return "\nUNION ALL ".join(parts)


QUADS = f"quads AS ({quads_select()})"
KEY = "TRY_CAST(regexp_extract({c}, '^urn:r:[a-z]+/([0-9]+)', 1) AS BIGINT)"


def key(c: str = "s") -> str:
    return KEY.format(c=c)


T = "s, p, o, o_kind, o_dt, o_lang"


def reach_ctes(src: str, x: str, live: bool = False) -> list[str]:
    """Backward path sets from urn:r:region/3 (x = name prefix)."""
    out = [
        f"{x}r_n AS (SELECT DISTINCT s AS node FROM {src} WHERE p = 'urn:p:n_regionkey' AND o = 'urn:r:region/3' AND o_kind = 'uri')",
        f"{x}r_c AS (SELECT DISTINCT q.s AS node FROM {src} q JOIN {x}r_n r ON q.o = r.node WHERE q.p = 'urn:p:c_nationkey' AND q.o_kind = 'uri')",
        f"{x}r_o AS (SELECT DISTINCT q.s AS node FROM {src} q JOIN {x}r_c r ON q.o = r.node WHERE q.p = 'urn:p:o_custkey' AND q.o_kind = 'uri')",
        f"{x}r_l AS (SELECT DISTINCT q.s AS node FROM {src} q JOIN {x}r_o r ON q.o = r.node WHERE q.p = 'urn:p:l_orderkey' AND q.o_kind = 'uri')",
        f"{x}r_p AS (SELECT DISTINCT q.o AS node FROM {src} q JOIN {x}r_l r ON q.s = r.node WHERE q.p = 'urn:p:l_partkey' AND q.o_kind = 'uri')",
    ]
    if live:
        out.append(f"{x}r_e AS (SELECT DISTINCT q.s AS node FROM {src} q JOIN {x}r_c r ON q.o = r.node WHERE q.p = 'urn:p:by' AND q.o_kind = 'uri')")
    return out


# Per-rule copy condition on a candidate quad q (graph, property, strict type).
RULE_COPY = {
    0: f"q.p IN ('urn:p:n_name', {RDF}) AND q.g <> {PUB}",
    1: f"(q.p IN ('urn:p:c_name', 'urn:p:c_mktsegment', 'urn:p:c_nationkey') OR (q.p = {RDF} AND q.o = 'urn:t:Customer')) AND q.g <> {PUB}",
    2: f"q.p IN ('urn:p:o_orderstatus', 'urn:p:o_totalprice', 'urn:p:o_custkey', {RDF}) AND q.g IN ('urn:g:orders/O', 'urn:g:orders/F')",
    3: f"q.p IN ('urn:p:l_quantity', 'urn:p:l_orderkey', 'urn:p:l_partkey', {RDF}) AND q.g <> {PUB}",
    4: f"q.p IN ('urn:p:p_name', 'urn:p:p_brand', {RDF}) AND q.g <> {PUB}",
    5: f"q.p IN ('urn:p:lang', 'urn:p:n_chars', {RDF}) AND regexp_matches(q.g, 'documents/src1')",
    6: f"q.p IN ('urn:p:bought', 'urn:p:lastViewed', 'urn:p:c_name', {RDF}) AND q.g <> {PUB}",
    7: f"q.p IN ('urn:p:by', {RDF}) AND q.g <> {PUB}",
}
RULE_TYPE = {0: "Nation", 1: "Customer", 2: "Order", 3: "Line", 4: "Part", 5: "Document", 6: "ActiveUser", 7: "Click"}
RULE_REACH = {0: "r_n", 1: "r_c", 2: "r_o", 3: "r_l", 4: "r_p", 6: "r_c", 7: "r_e"}


def scoped_cte(src: str, x: str, rules, types_src: str | None = None, paths: bool = True,
               doc_filter: str | None = "o = '1'") -> str:
    types_src = types_src or src
    parts = []
    for r in rules:
        sel = (f"SELECT DISTINCT s, {r} AS rule_no FROM {types_src} WHERE p = {RDF} AND o_kind = 'uri' "
               f"AND o = 'urn:t:{RULE_TYPE[r]}'")
        if r in RULE_REACH and paths:
            sel += f" AND s IN (SELECT node FROM {x}{RULE_REACH[r]})"
        if r == 5 and doc_filter:
            sel += f" AND s IN (SELECT s FROM {src} WHERE p = 'urn:p:quality' AND {doc_filter})"
        parts.append(sel)
    return f"{x}scoped AS ({' UNION ALL '.join(parts)})"


def expected_ctes(src: str, x: str, rules=(0, 1, 2, 3, 4, 5), live: bool = False, types_src: str | None = None,
                  paths: bool = True, copy: dict | None = None, doc_filter: str | None = "o = '1'",
                  bag: bool = False) -> list[str]:
    """CTEs ending in ``{x}a`` = expected set of the given rules over ``src``."""
    copy = copy or RULE_COPY
    cond = " OR ".join(f"(c.rule_no = {r} AND {copy[r]})" for r in rules)
    ctes = reach_ctes(src, x, live) if paths else []
    ctes.append(scoped_cte(src, x, rules, types_src, paths, doc_filter))
    d = "" if bag else "DISTINCT "
    ctes.append(f"{x}a AS (SELECT {d}q.s, q.p, q.o, q.o_kind, q.o_dt, q.o_lang FROM {src} q "
                f"JOIN {x}scoped c ON q.s = c.s WHERE {cond})")
    return ctes


def current_ctes(pub: str, x: str, rules=(0, 1, 2, 3, 4, 5)) -> list[str]:
    """CTE ``{x}b`` = configured triples of typed subjects in ``pub``."""
    props = {
        0: ["urn:p:n_name"], 1: ["urn:p:c_name", "urn:p:c_mktsegment", "urn:p:c_nationkey"],
        2: ["urn:p:o_orderstatus", "urn:p:o_totalprice", "urn:p:o_custkey"],
        3: ["urn:p:l_quantity", "urn:p:l_orderkey", "urn:p:l_partkey"], 4: ["urn:p:p_name", "urn:p:p_brand"],
        5: ["urn:p:lang", "urn:p:n_chars"], 6: ["urn:p:bought", "urn:p:lastViewed", "urn:p:c_name"],
        7: ["urn:p:by"],
    }
    parts = []
    for r in rules:
        plist = ", ".join(f"'{p}'" for p in props[r]) + f", {RDF}"
        parts.append(f"SELECT DISTINCT q.s, q.p, q.o, q.o_kind, q.o_dt, q.o_lang FROM {pub} q WHERE q.p IN ({plist}) "
                     f"AND q.s IN (SELECT s FROM {pub} WHERE p = {RDF} AND o = 'urn:t:{RULE_TYPE[r]}')")
    return [f"{x}b AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}))"]


def drift_ctes() -> list[str]:
    """``pub`` = drifted publication (FIXTURES §4) built from ``a``."""
    return [
        *expected_ctes("quads", "u_", paths=False),
        f"kept AS (SELECT * FROM a WHERE {key()} % 7 <> 3)",
        f"stale AS (SELECT s, p, o || '-stale' AS o, o_kind, o_dt, o_lang FROM kept "
        f"WHERE {key()} % 11 = 5 AND o_kind = 'literal' AND o_dt = '')",
        f"outside AS (SELECT * FROM u_a WHERE {key()} % 13 = 1 AND s NOT IN (SELECT s FROM a))",
        f"orphans AS (SELECT 'urn:r:ghost/' || CAST({key()} AS VARCHAR) AS s, p, o, o_kind, o_dt, o_lang FROM a "
        f"WHERE s LIKE 'urn:r:customer/%' AND {key()} % 50 = 0 AND p = 'urn:p:c_name')",
        "pub AS (SELECT DISTINCT * FROM (SELECT * FROM kept UNION ALL SELECT * FROM stale "
        "UNION ALL SELECT * FROM outside UNION ALL SELECT * FROM orphans))",
    ]


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


HEAL = [QUADS, *expected_ctes("quads", ""), *drift_ctes(), *current_ctes("pub", "")]


def heal_diff_sql() -> str:
    return w(*HEAL) + (
        "SELECT 'insert' AS op, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) "
        "UNION ALL SELECT 'delete' AS op, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")


SQL: dict[str, str] = {}

SQL["quads_from_tables"] = w(QUADS) + f"SELECT g, {T} FROM quads"
SQL["type_scan_by_graph"] = w(QUADS) + (
    f"SELECT g, o AS type, COUNT(DISTINCT s) AS n_subjects FROM quads WHERE p = {RDF} AND o_kind = 'uri' GROUP BY g, o")
SQL["rule_property_map"] = w(QUADS, f"""rp(p, rule_nos) AS (VALUES
  ('urn:p:n_name', '0'), ('urn:p:c_name', '1'), ('urn:p:c_mktsegment', '1'), ('urn:p:c_nationkey', '1'),
  ('urn:p:o_orderstatus', '2'), ('urn:p:o_totalprice', '2'), ('urn:p:o_custkey', '2'),
  ('urn:p:l_quantity', '3'), ('urn:p:l_orderkey', '3'), ('urn:p:l_partkey', '3,4'),
  ('urn:p:p_name', '4'), ('urn:p:p_brand', '4'), ('urn:p:lang', '5'), ('urn:p:n_chars', '5'),
  ({RDF}, '0,1,2,3,4,5'))""") + (
    "SELECT rp.p, rp.rule_nos, COALESCE(c.n, 0) AS n_quads FROM rp "
    "LEFT JOIN (SELECT p, COUNT(*) AS n FROM quads GROUP BY p) c ON rp.p = c.p")
SQL["path_scope_forward"] = w(QUADS, *reach_ctes("quads", "")) + "SELECT node FROM r_l"
SQL["path_scope_inverse"] = w(QUADS, *reach_ctes("quads", "")) + "SELECT node FROM r_p"
SQL["graph_exclude_publication"] = w(
    QUADS, *expected_ctes("quads", ""), *drift_ctes(),
    f"store AS (SELECT g, {T} FROM quads UNION ALL SELECT {PUB} AS g, {T} FROM pub)",
    *expected_ctes("store", "st_")) + "SELECT * FROM st_a"
SQL["graph_allow_list"] = w(QUADS, *expected_ctes("quads", "", rules=(2,))) + "SELECT * FROM a"
SQL["graph_regex_filter"] = w(QUADS, *expected_ctes("quads", "", rules=(5,), doc_filter=None)) + "SELECT * FROM a"
SQL["strict_type_export"] = w(QUADS, *expected_ctes("quads", "", rules=(1,))) + "SELECT * FROM a"
SQL["inverse_property_export"] = w(QUADS, *reach_ctes("quads", ""),
                                   scoped_cte("quads", "", (4,))) + (
    "SELECT DISTINCT q.s, q.p, q.o, q.o_kind, q.o_dt, q.o_lang FROM quads q JOIN scoped c ON q.s = c.s "
    f"WHERE q.p IN ('urn:p:p_name', 'urn:p:p_brand', {RDF}) AND q.g <> {PUB} "
    "UNION SELECT q.s, q.p, q.o, q.o_kind, q.o_dt, q.o_lang FROM quads q JOIN scoped c ON q.o = c.s "
    f"WHERE q.p = 'urn:p:l_partkey' AND q.o_kind = 'uri' AND q.g <> {PUB}")
SQL["additional_filter_expr"] = w(QUADS, *expected_ctes("quads", "", rules=(2,))) + (
    "SELECT * FROM a WHERE s IN (SELECT s FROM quads WHERE p = 'urn:p:o_totalprice' "
    "AND TRY_CAST(o AS DOUBLE) > 200000)")
SQL["filter_from_config"] = SQL["additional_filter_expr"]
SQL["additional_filter_on_triple"] = w(QUADS, *expected_ctes("quads", "", rules=(2,))) + (
    "SELECT * FROM a WHERE p <> 'urn:p:o_totalprice' OR TRY_CAST(o AS DOUBLE) > 200000")
SQL["additional_filter_pattern"] = w(QUADS, *expected_ctes("quads", "", rules=(5,))) + "SELECT * FROM a"
SQL["expected_publication"] = w(QUADS, *expected_ctes("quads", "")) + "SELECT * FROM a"
SQL["current_publication"] = w(*HEAL) + "SELECT * FROM b"
SQL["heal_diff"] = heal_diff_sql()
SQL["heal_diff_bag"] = w(*HEAL, *expected_ctes("quads", "bag_", bag=True)) + (
    "SELECT 'insert' AS op, * FROM (SELECT * FROM bag_a EXCEPT ALL SELECT * FROM b) "
    "UNION ALL SELECT 'delete' AS op, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM bag_a)")
DIFF = ("diff AS (SELECT 'insert' AS op, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) "
        "UNION ALL SELECT 'delete' AS op, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
SQL["heal_report_counts"] = w(*HEAL, DIFF) + "SELECT op, p, COUNT(*) AS n_triples FROM diff GROUP BY op, p"
SQL["publication_orphans"] = w(*HEAL) + "SELECT * FROM pub EXCEPT SELECT * FROM b"
PATCHED = ("after AS (SELECT * FROM pub EXCEPT SELECT s, p, o, o_kind, o_dt, o_lang FROM diff WHERE op = 'delete' "
           "UNION SELECT s, p, o, o_kind, o_dt, o_lang FROM diff WHERE op = 'insert')")
SQL["apply_patch"] = w(*HEAL, DIFF, PATCHED) + "SELECT * FROM after"
SQL["heal_delta_files"] = w(*HEAL, DIFF, "n AS (SELECT COUNT(*) FILTER (op = 'delete') AS n_del FROM diff)") + (
    "SELECT k // 10 AS file_no, CAST(k % 10 AS INTEGER) AS slot, op, COUNT(*) AS n_triples FROM (SELECT op, (row_number() OVER (PARTITION BY op ORDER BY s, p, o, o_kind, o_dt, o_lang) - 1) // 100 "
    "+ CASE WHEN op = 'insert' THEN CAST(ceil((SELECT n_del FROM n) / 100.0) AS BIGINT) ELSE 0 END AS k FROM diff) GROUP BY k, op")
SQL["heal_idempotent"] = w(*HEAL, DIFF, PATCHED, *current_ctes("after", "x_")) + (
    "SELECT (SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM x_b)) AS n_inserts, "
    "(SELECT COUNT(*) FROM (SELECT * FROM x_b EXCEPT SELECT * FROM a)) AS n_deletes")


# ------------------------------------------------------------------ live flow

PROPS = {
    0: ["urn:p:n_name"], 1: ["urn:p:c_name", "urn:p:c_mktsegment", "urn:p:c_nationkey"],
    2: ["urn:p:o_orderstatus", "urn:p:o_totalprice", "urn:p:o_custkey"],
    3: ["urn:p:l_quantity", "urn:p:l_orderkey", "urn:p:l_partkey"], 4: ["urn:p:p_name", "urn:p:p_brand"],
    5: ["urn:p:lang", "urn:p:n_chars"], 6: ["urn:p:bought", "urn:p:lastViewed", "urn:p:c_name"], 7: ["urn:p:by"],
}
GRAPH_OK = {2: "{q}.g IN ('urn:g:orders/O', 'urn:g:orders/F')", 5: "regexp_matches({q}.g, 'documents/src1')"}


def graph_ok(r: int, q: str = "q") -> str:
    return GRAPH_OK.get(r, "{q}.g <> " + PUB).format(q=q)


def configured(r: int, q: str = "q") -> str:
    plist = ", ".join(f"'{p}'" for p in PROPS[r])
    if r == 1:
        return f"({q}.p IN ({plist}) OR ({q}.p = {RDF} AND {q}.o = 'urn:t:Customer'))"
    return f"{q}.p IN ({plist}, {RDF})"


def source_copy(rc: str, q: str = "q", rules=range(8)) -> str:
    """Forward S3 condition for rule column ``rc`` on quad alias ``q``."""
    return " OR ".join(f"({rc} = {r} AND {configured(r, q)} AND {graph_ok(r, q)})" for r in rules)


def published_copy(rc: str, q: str = "q", rules=range(8)) -> str:
    """Forward S4 property condition (no strict type)."""
    return " OR ".join(
        f"({rc} = {r} AND {q}.p IN ({', '.join(repr(p) for p in PROPS[r])}, {RDF}))" for r in rules)


RULE_TYPES = ("rt(type, rule_no, first_step) AS (VALUES ('urn:t:Nation', 0, 'urn:p:n_regionkey'), "
              "('urn:t:Customer', 1, 'urn:p:c_nationkey'), ('urn:t:Order', 2, 'urn:p:o_custkey'), "
              "('urn:t:Line', 3, 'urn:p:l_orderkey'), ('urn:t:Part', 4, '^urn:p:l_partkey'), "
              "('urn:t:Document', 5, NULL), ('urn:t:ActiveUser', 6, 'urn:p:c_nationkey'), "
              "('urn:t:Click', 7, 'urn:p:by'))")
CHILDREN = ("ch(parent_rule, child_rule, child_type, child_first_step) AS (VALUES "
            "(0, 1, 'urn:t:Customer', 'urn:p:c_nationkey'), (0, 6, 'urn:t:ActiveUser', 'urn:p:c_nationkey'), "
            "(1, 2, 'urn:t:Order', 'urn:p:o_custkey'), (6, 2, 'urn:t:Order', 'urn:p:o_custkey'), "
            "(1, 7, 'urn:t:Click', 'urn:p:by'), (6, 7, 'urn:t:Click', 'urn:p:by'), "
            "(2, 3, 'urn:t:Line', 'urn:p:l_orderkey'), (3, 4, 'urn:t:Part', '^urn:p:l_partkey'))")

EV = ("ev AS (SELECT event_id, user_id, event_type, "
      "CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS part FROM events)")


def _chg(op: str, j: int, s: str, p: str, o: str, where: str) -> str:
    return (f"SELECT event_id // 100 AS msg_id, CAST((event_id % 100) // 10 AS INTEGER) AS cs_no, '{op}' AS op, "
            f"CAST((event_id % 10) * 2 + {j} AS INTEGER) AS pos, event_id, {s} AS s, {p} AS p, {o} AS o, "
            f"'uri' AS o_kind FROM ev WHERE event_type = '{where}'")


CUST = "'urn:r:customer/' || CAST(user_id AS VARCHAR)"
EVT = "'urn:r:event/' || CAST(event_id AS VARCHAR)"
PART = "'urn:r:part/' || CAST(part AS VARCHAR)"
CHANGES = "changes AS (" + " UNION ALL ".join([
    _chg("insert", 0, CUST, RDF, "'urn:t:ActiveUser'", "signup"),
    _chg("insert", 0, EVT, RDF, "'urn:t:Click'", "click"),
    _chg("insert", 1, EVT, "'urn:p:by'", CUST, "click"),
    _chg("insert", 0, CUST, "'urn:p:bought'", PART, "purchase"),
    _chg("delete", 0, CUST, "'urn:p:bought'", PART, "error"),
    _chg("delete", 0, CUST, "'urn:p:lastViewed'", PART, "view"),
    _chg("insert", 1, CUST, "'urn:p:lastViewed'", PART, "view"),
]) + ")"


def _state(name: str, where: str) -> str:
    return (f"{name} AS (SELECT s, p, o, o_kind FROM (SELECT *, row_number() OVER (PARTITION BY s, p, o, o_kind "
            f"ORDER BY event_id DESC, CASE WHEN op = 'delete' THEN 0 ELSE 1 END DESC) AS rn FROM changes "
            f"WHERE {where}) WHERE rn = 1 AND op = 'insert')")


LIVE_BASE = [
    QUADS, EV, CHANGES,
    "m0 AS (SELECT (MAX(msg_id) + 1) // 2 AS m FROM changes)",
    _state("st_early", "msg_id < (SELECT m FROM m0)"),
    _state("st_all", "TRUE"),
    f"src_before AS (SELECT g, {T} FROM quads UNION ALL SELECT 'urn:g:events', s, p, o, o_kind, '', '' FROM st_early)",
    f"src_after AS (SELECT g, {T} FROM quads UNION ALL SELECT 'urn:g:events', s, p, o, o_kind, '', '' FROM st_all)",
    *expected_ctes("src_before", "pb_", rules=tuple(range(8)), live=True),
    "batch AS (SELECT * FROM changes WHERE msg_id >= (SELECT m FROM m0))",
    *reach_ctes("src_after", "sa_", live=True),
    RULE_TYPES, CHILDREN,
    f"stypes AS (SELECT DISTINCT s AS uri, o AS type FROM src_after WHERE p = {RDF} AND o_kind = 'uri' "
    f"UNION SELECT s, o FROM pb_a WHERE p = {RDF} AND o_kind = 'uri')",
    f"ctypes AS (SELECT DISTINCT msg_id, cs_no, s AS uri, o AS type FROM batch WHERE p = {RDF})",
]


def types_for(name: str, uris: str) -> str:
    """(msg_id, cs_no, uri, type, rule_no, first_step) for a CTE of (msg_id, cs_no, uri)."""
    return (f"{name} AS (SELECT DISTINCT t.msg_id, t.cs_no, t.uri, t.type, rt.rule_no, rt.first_step FROM ("
            f"SELECT u.msg_id, u.cs_no, u.uri, s.type FROM {uris} u JOIN stypes s ON s.uri = u.uri "
            f"UNION SELECT u.msg_id, u.cs_no, u.uri, c.type FROM {uris} u JOIN ctypes c "
            f"ON c.msg_id = u.msg_id AND c.cs_no = u.cs_no AND c.uri = u.uri) t JOIN rt ON rt.type = t.type)")


REACH_OF = {0: "sa_r_n", 1: "sa_r_c", 2: "sa_r_o", 3: "sa_r_l", 4: "sa_r_p", 6: "sa_r_c", 7: "sa_r_e"}


def in_scope_cond(u: str, rc: str, src: str = "src_after", reach=REACH_OF) -> str:
    path = " OR ".join(f"({rc} = {r} AND {u} IN (SELECT node FROM {n}))" for r, n in reach.items())
    graph = " OR ".join(f"({rc} = {r} AND {graph_ok(r, 'q')})" for r in range(8))
    return (f"(({path}) OR {rc} = 5) AND EXISTS (SELECT 1 FROM {src} q WHERE q.s = {u} AND ({graph})) "
            f"AND ({rc} <> 5 OR {u} IN (SELECT s FROM {src} WHERE p = 'urn:p:quality' AND o = '1'))")


R1 = [
    "buris AS (SELECT DISTINCT msg_id, cs_no, s AS uri FROM batch UNION SELECT msg_id, cs_no, o FROM batch WHERE o_kind = 'uri')",
    types_for("tc", "buris"),
    "ins AS (SELECT DISTINCT msg_id, cs_no, s, p, o, o_kind, '' AS o_dt, '' AS o_lang FROM batch WHERE op = 'insert')",
    "x AS (SELECT i.*, tc.rule_no FROM ins i JOIN tc ON tc.msg_id = i.msg_id AND tc.cs_no = i.cs_no AND tc.uri = i.s)",
    "xs AS (SELECT * FROM x WHERE " + in_scope_cond("x.s", "x.rule_no") + ")",
    "copied AS (SELECT DISTINCT msg_id, cs_no, s, p, o, o_kind, o_dt, o_lang FROM xs q WHERE "
    + " OR ".join(f"(q.rule_no = {r} AND {configured(r)})" for r in range(8) if r != 5) + ")",
    "rel AS (SELECT DISTINCT msg_id, cs_no, s, p, o FROM copied WHERE o_kind = 'uri')",
    "relo AS (SELECT DISTINCT msg_id, cs_no, o AS uri FROM rel)",
    "rels AS (SELECT DISTINCT msg_id, cs_no, s AS uri FROM rel)",
    types_for("tco", "relo"), types_for("tcs", "rels"),
    "imp AS (SELECT r.msg_id, r.cs_no, r.s AS uri, t.rule_no FROM rel r JOIN tcs t ON t.msg_id = r.msg_id "
    "AND t.cs_no = r.cs_no AND t.uri = r.s WHERE t.first_step = r.p "
    "UNION SELECT r.msg_id, r.cs_no, r.o, ch.child_rule FROM rel r JOIN tcs t ON t.msg_id = r.msg_id "
    "AND t.cs_no = r.cs_no AND t.uri = r.s JOIN ch ON ch.parent_rule = t.rule_no "
    "WHERE ch.child_first_step = '^' || r.p AND EXISTS (SELECT 1 FROM tco o WHERE o.msg_id = r.msg_id "
    "AND o.cs_no = r.cs_no AND o.uri = r.o AND o.type = ch.child_type))",
]


def support_ctes(src: str, x: str, live: bool) -> str:
    """CTE ``{x}sup(path, node, n)``: supports of every rest of the rules' paths, over ``reach_ctes(src, x, live)``."""
    step = "SELECT '{path}' AS path, {near} AS node, COUNT(*) AS n FROM (SELECT DISTINCT s, o FROM {src} WHERE p = 'urn:p:{p}' AND o_kind = 'uri') e WHERE {far} GROUP BY 2"
    parts = [("n_regionkey", "n_regionkey", "s", "o = 'urn:r:region/3'"), ("c_nationkey / n_regionkey", "c_nationkey", "s", f"o IN (SELECT node FROM {x}r_n)"),
             ("o_custkey / c_nationkey / n_regionkey", "o_custkey", "s", f"o IN (SELECT node FROM {x}r_c)"),
             ("l_orderkey / o_custkey / c_nationkey / n_regionkey", "l_orderkey", "s", f"o IN (SELECT node FROM {x}r_o)"),
             ("^l_partkey / l_orderkey / o_custkey / c_nationkey / n_regionkey", "l_partkey", "o", f"s IN (SELECT node FROM {x}r_l)")]
    if live:
        parts.append(("by / c_nationkey / n_regionkey", "by", "s", f"o IN (SELECT node FROM {x}r_c)"))
    return f"{x}sup AS (" + " UNION ALL ".join(step.format(path=path, near=near, src=src, p=p, far=far) for path, p, near, far in parts) + ")"


def without(predicate: str) -> str:
    """CTE ``less``: the quads without the links of subjects with key % 17 = 2."""
    return f"less AS (SELECT * FROM quads WHERE NOT (p = 'urn:p:{predicate}' AND coalesce({key()} % 17 = 2, false)))"


def changed_publication(predicate: str, full_first: bool) -> str:
    old, new = ("x_a", "y_a") if full_first else ("y_a", "x_a")
    return w(QUADS, without(predicate), *expected_ctes("quads", "x_"), *expected_ctes("less", "y_")) + (
        f"SELECT 'insert' AS op, * FROM (SELECT * FROM {new} EXCEPT SELECT * FROM {old}) "
        f"UNION ALL SELECT 'delete' AS op, * FROM (SELECT * FROM {old} EXCEPT SELECT * FROM {new})")


SQL["reach_maintained"] = w(*LIVE_BASE, support_ctes("src_after", "sa_", True)) + "SELECT path, node, n FROM sa_sup"
SQL["reach_retracted"] = w(QUADS, without("c_nationkey"), *reach_ctes("quads", "x_"), *reach_ctes("less", "y_"), support_ctes("quads", "x_", False), support_ctes("less", "y_", False)) + (
    "SELECT path, node, coalesce(x.n, 0) AS was, coalesce(y.n, 0) AS now FROM x_sup x FULL JOIN y_sup y USING (path, node) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)")
SQL["strict_delete"] = changed_publication("c_nationkey", True)
SQL["strict_enrich"] = changed_publication("o_custkey", False)
SQL["explode_changes"] = w(EV, CHANGES) + "SELECT * FROM changes"
SQL["type_cache"] = w(*LIVE_BASE, *R1[:2]) + "SELECT DISTINCT msg_id, cs_no, uri, rule_no FROM tc"
SQL["dispatch_streams"] = w(*LIVE_BASE) + (
    "SELECT DISTINCT t.msg_id, s.stream FROM (SELECT msg_id, o AS type FROM changes WHERE p = " + RDF +
    " UNION SELECT u.msg_id, st.o FROM (SELECT msg_id, s AS uri FROM changes UNION SELECT msg_id, o FROM changes "
    "WHERE o_kind = 'uri') u JOIN src_after st ON st.s = u.uri AND st.p = " + RDF + ") t "
    "JOIN (SELECT 'base' AS stream, type FROM rt WHERE rule_no <= 5 UNION ALL SELECT 'live', type FROM rt) s "
    "ON s.type = t.type")
SQL["rewrite_inserts"] = w(*LIVE_BASE, *R1) + "SELECT * FROM copied"
SQL["impacted_resources"] = w(*LIVE_BASE, *R1) + (
    "SELECT msg_id, cs_no, uri, MIN(rule_no) AS rule_no FROM imp GROUP BY ALL" if False else
    "SELECT DISTINCT * FROM imp")

# R3 first level on the live batch
R3 = [
    "dsub AS (SELECT DISTINCT msg_id, cs_no, s AS uri FROM batch WHERE op = 'delete')",
    types_for("dtc", "dsub"),
    "s3 AS (SELECT d.msg_id, d.cs_no, d.uri, q.s, q.p, q.o, q.o_kind, q.o_dt, q.o_lang FROM dtc d "
    "JOIN src_after q ON q.s = d.uri WHERE " + source_copy("d.rule_no") +
    " UNION SELECT d.msg_id, d.cs_no, d.uri, q.s, q.p, q.o, q.o_kind, q.o_dt, q.o_lang FROM dtc d "
    f"JOIN src_after q ON q.o = d.uri WHERE d.rule_no = 4 AND q.p = 'urn:p:l_partkey' AND q.o_kind = 'uri' AND q.g <> {PUB})",
    "s4 AS (SELECT d.msg_id, d.cs_no, d.uri, q.s, q.p, q.o, q.o_kind, q.o_dt, q.o_lang FROM dtc d "
    "JOIN pb_a q ON q.s = d.uri WHERE (" + published_copy("d.rule_no") + ") AND EXISTS (SELECT 1 FROM pb_a t "
    f"WHERE t.s = d.uri AND t.p = {RDF} AND t.o = d.type) "
    "UNION SELECT d.msg_id, d.cs_no, d.uri, q.s, q.p, q.o, q.o_kind, q.o_dt, q.o_lang FROM dtc d "
    "JOIN pb_a q ON q.o = d.uri WHERE d.rule_no = 4 AND q.p = 'urn:p:l_partkey' AND EXISTS (SELECT 1 FROM pb_a t "
    f"WHERE t.s = d.uri AND t.p = {RDF} AND t.o = d.type))",
    "removed AS (SELECT DISTINCT msg_id, cs_no, s, p, o, o_kind, o_dt, o_lang FROM "
    "(SELECT * FROM s4 EXCEPT SELECT * FROM s3))",
]
SQL["rewrite_deletes"] = w(*LIVE_BASE, *R3) + "SELECT * FROM removed"

# the same on a batch of messages: what earlier messages insert counts as published
R3_BATCH = [
    "ins_first AS (SELECT s, p, o, o_kind, o_dt, o_lang, MIN(msg_id) AS since FROM (SELECT msg_id, s, p, o, o_kind, o_dt, o_lang FROM copied "
    "UNION ALL SELECT msg_id, s, p, o, o_kind, o_dt, o_lang FROM enr) GROUP BY ALL)",
    "pub_all AS (SELECT s, p, o, o_kind, o_dt, o_lang FROM pb_a UNION SELECT s, p, o, o_kind, o_dt, o_lang FROM ins_first)",
    *R3[:3], R3[3].replace("pb_a", "pub_all"),
    "removed AS (SELECT DISTINCT x.msg_id, x.cs_no, x.s, x.p, x.o, x.o_kind, x.o_dt, x.o_lang FROM "
    "(SELECT * FROM s4 EXCEPT SELECT * FROM s3) x LEFT JOIN ins_first f USING (s, p, o, o_kind, o_dt, o_lang) "
    "WHERE (x.s, x.p, x.o, x.o_kind, x.o_dt, x.o_lang) IN (SELECT s, p, o, o_kind, o_dt, o_lang FROM pb_a) OR f.since < x.msg_id)",
]

# enrichment round: export of impacted resources in scope (rule 7 clicks on this data)
ENRICH = [
    "impr AS (SELECT msg_id, cs_no, uri, MIN(rule_no) AS rule_no FROM imp GROUP BY msg_id, cs_no, uri)",
    "impok AS (SELECT * FROM impr WHERE " + in_scope_cond("impr.uri", "impr.rule_no") + ")",
    "enr AS (SELECT i.msg_id, i.cs_no, q.s, q.p, q.o, q.o_kind, q.o_dt, q.o_lang FROM impok i "
    "JOIN src_after q ON q.s = i.uri WHERE " + source_copy("i.rule_no") + ")",
]
FOLD_NET = [
    "rw_i AS (SELECT DISTINCT msg_id, s, p, o, o_kind, o_dt, o_lang FROM (SELECT msg_id, s, p, o, o_kind, o_dt, o_lang FROM copied "
    "UNION ALL SELECT msg_id, s, p, o, o_kind, o_dt, o_lang FROM enr))",
    "rw_d AS (SELECT DISTINCT msg_id, s, p, o, o_kind, o_dt, o_lang FROM removed)",
    "folded AS (SELECT 'delete' AS op, * FROM (SELECT * FROM rw_d EXCEPT SELECT * FROM rw_i) "
    "UNION ALL SELECT 'insert', * FROM (SELECT * FROM rw_i EXCEPT SELECT * FROM rw_d))",
    "lastop AS (SELECT s, p, o, o_kind, o_dt, o_lang, arg_max(op, msg_id) AS op FROM folded GROUP BY ALL)",
    "net AS (SELECT l.op, l.s, l.p, l.o, l.o_kind, l.o_dt, l.o_lang FROM lastop l "
    "WHERE (l.op = 'delete') = ((l.s, l.p, l.o, l.o_kind, l.o_dt, l.o_lang) IN (SELECT s, p, o, o_kind, o_dt, o_lang FROM pb_a)))",
]
LIVE_NET = w(*LIVE_BASE, *R1, *ENRICH, *R3_BATCH, *FOLD_NET)
SQL["live_flow_net"] = LIVE_NET + "SELECT * FROM net"

SQL["fold_cancel"] = w(EV, CHANGES) + (
    "SELECT msg_id, 'delete' AS op, s, p, o, o_kind, '' AS o_dt, '' AS o_lang FROM "
    "(SELECT msg_id, s, p, o, o_kind FROM changes WHERE op = 'delete' EXCEPT "
    "SELECT msg_id, s, p, o, o_kind FROM changes WHERE op = 'insert') UNION ALL "
    "SELECT msg_id, 'insert', s, p, o, o_kind, '', '' FROM (SELECT msg_id, s, p, o, o_kind FROM changes "
    "WHERE op = 'insert' EXCEPT SELECT msg_id, s, p, o, o_kind FROM changes WHERE op = 'delete')")
SQL["fold_last_write"] = w(EV, CHANGES) + (
    "SELECT op, s, p, o, o_kind, '' AS o_dt, '' AS o_lang FROM (SELECT *, row_number() OVER ("
    "PARTITION BY s, p, o, o_kind ORDER BY msg_id DESC, cs_no DESC, pos DESC, "
    "CASE WHEN op = 'delete' THEN 0 ELSE 1 END DESC) AS rn FROM changes) WHERE rn = 1")
SQL["effective_changes"] = w(*LIVE_BASE) + (
    "SELECT 'delete' AS op, * FROM (SELECT s, p, o, o_kind, '' AS o_dt, '' AS o_lang FROM batch WHERE op = 'delete' "
    "EXCEPT SELECT s, p, o, o_kind, '', '' FROM batch WHERE op = 'insert') "
    "WHERE (s, p, o, o_kind, o_dt, o_lang) IN (SELECT s, p, o, o_kind, o_dt, o_lang FROM pb_a) "
    "UNION ALL SELECT 'insert', * FROM (SELECT s, p, o, o_kind, '', '' FROM batch WHERE op = 'insert' "
    "EXCEPT SELECT s, p, o, o_kind, '', '' FROM batch WHERE op = 'delete' EXCEPT SELECT * FROM pb_a)")

# §5.2: completed links bring lines (J5) and their parts
SQL["enrich_closure"] = w(QUADS, *reach_ctes("quads", ""),
    f"msg AS (SELECT DISTINCT s, p, o, o_kind FROM quads WHERE p = 'urn:p:l_orderkey' AND {key('o')} % 17 = 2)",
    f"eu AS (SELECT DISTINCT s FROM msg WHERE s IN (SELECT node FROM r_l) "
    f"AND s IN (SELECT s FROM quads WHERE p = {RDF} AND o = 'urn:t:Line'))",
    "copied AS (SELECT s, p, o, o_kind, '' AS o_dt, '' AS o_lang FROM msg WHERE s IN (SELECT s FROM eu))",
    f"line_exp AS (SELECT {T} FROM quads q WHERE q.s IN (SELECT s FROM eu) AND {configured(3)} AND q.g <> {PUB})",
    f"parts AS (SELECT DISTINCT o AS s FROM line_exp WHERE p = 'urn:p:l_partkey' AND o IN (SELECT node FROM r_p) "
    f"AND o IN (SELECT s FROM quads WHERE p = {RDF} AND o = 'urn:t:Part'))",
    f"part_exp AS (SELECT {T} FROM quads q WHERE q.s IN (SELECT s FROM parts) AND {configured(4)} AND q.g <> {PUB} "
    f"UNION SELECT {T} FROM quads q WHERE q.o IN (SELECT s FROM parts) AND q.p = 'urn:p:l_partkey' "
    f"AND q.o_kind = 'uri' AND q.g <> {PUB})",
) + "SELECT * FROM copied UNION SELECT * FROM line_exp UNION SELECT * FROM part_exp"

# §5.3: a split delete removes lines, cascades to their orders; parts and customers stay
SQL["cascade_deletes"] = w(QUADS, *expected_ctes("quads", ""),
    f"after AS (SELECT * FROM quads WHERE NOT ((s LIKE 'urn:r:line/%' OR s LIKE 'urn:r:order/%') AND {key()} % 17 = 2))",
    f"dl AS (SELECT DISTINCT s FROM quads WHERE s LIKE 'urn:r:line/%' AND {key()} % 17 = 2)",
    f"rm_lines AS (SELECT * FROM a WHERE s IN (SELECT s FROM dl) AND s IN (SELECT s FROM a WHERE p = {RDF} "
    f"AND o = 'urn:t:Line') AND p IN ('urn:p:l_quantity', 'urn:p:l_orderkey', 'urn:p:l_partkey', {RDF}) "
    f"EXCEPT SELECT {T} FROM after)",
    "ords AS (SELECT DISTINCT o AS s FROM rm_lines WHERE p = 'urn:p:l_orderkey')",
    f"rm_orders AS (SELECT * FROM a WHERE s IN (SELECT s FROM ords) AND s IN (SELECT s FROM a WHERE p = {RDF} "
    f"AND o = 'urn:t:Order') AND p IN ('urn:p:o_orderstatus', 'urn:p:o_totalprice', 'urn:p:o_custkey', {RDF}) "
    f"EXCEPT SELECT {T} FROM after q WHERE {configured(2)} AND {graph_ok(2)})",
) + "SELECT * FROM rm_lines UNION SELECT * FROM rm_orders"


# --------------------------------------------------- feed, terms, control

FOLD_MSG = ("fc AS (SELECT msg_id, 'delete' AS op, s, p, o, o_kind, '' AS o_dt, '' AS o_lang FROM "
            "(SELECT msg_id, s, p, o, o_kind FROM changes WHERE op = 'delete' EXCEPT "
            "SELECT msg_id, s, p, o, o_kind FROM changes WHERE op = 'insert') UNION ALL "
            "SELECT msg_id, 'insert', s, p, o, o_kind, '', '' FROM (SELECT msg_id, s, p, o, o_kind FROM changes "
            "WHERE op = 'insert' EXCEPT SELECT msg_id, s, p, o, o_kind FROM changes WHERE op = 'delete'))")
CHUNKS = [
    EV, CHANGES, FOLD_MSG,
    "side AS (SELECT msg_id, op, COUNT(*) AS n FROM fc GROUP BY msg_id, op)",
    "sp AS (SELECT msg_id, MAX(n) > 100 AS split FROM side GROUP BY msg_id)",
    "r AS (SELECT fc.*, (row_number() OVER (PARTITION BY msg_id, op ORDER BY s, p, o, o_kind, o_dt, o_lang) - 1) // 100 "
    "AS chunk FROM fc)",
    "nc AS (SELECT msg_id, op, MAX(chunk) + 1 AS nchunks FROM r GROUP BY msg_id, op)",
    "goff AS (SELECT msg_id, op, COALESCE(SUM(nchunks) OVER (PARTITION BY msg_id ORDER BY "
    "CASE WHEN op = 'delete' THEN 0 ELSE 1 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g_off FROM nc)",
    "pc AS (SELECT n.msg_id, CASE WHEN sp.split THEN SUM(n.nchunks) ELSE 1 END AS n_out FROM nc n "
    "JOIN sp ON sp.msg_id = n.msg_id GROUP BY n.msg_id, sp.split)",
    "co AS (SELECT msg_id, COALESCE(SUM(n_out) OVER (ORDER BY msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS cs_off FROM pc)",
    "outn AS (SELECT r.*, CAST(co.cs_off + CASE WHEN sp.split THEN goff.g_off + r.chunk ELSE 0 END AS BIGINT) AS out_no "
    "FROM r JOIN sp ON sp.msg_id = r.msg_id JOIN goff ON goff.msg_id = r.msg_id AND goff.op = r.op "
    "JOIN co ON co.msg_id = r.msg_id)",
]
SQL["delta_file_chunks"] = w(*CHUNKS) + (
    "SELECT out_no // 10 AS file_no, CAST(out_no % 10 AS INTEGER) AS slot, op, COUNT(*) AS n_triples "
    "FROM outn GROUP BY out_no // 10, out_no % 10, op")
SQL["delta_file_feed"] = w(*CHUNKS, "base AS (SELECT MAX(ts) AS b FROM events)") + (
    "SELECT DISTINCT 'delta-b0-' || CAST(out_no // 10 AS VARCHAR) || '.json' AS name, "
    "(SELECT b FROM base) + to_milliseconds(out_no // 10) AS created FROM outn "
    "WHERE (SELECT b FROM base) + to_milliseconds(out_no // 10) > (SELECT b FROM base) + INTERVAL 3 MILLISECOND "
    "ORDER BY created, name LIMIT 1000")
SQL["replay_feed"] = LIVE_NET + (
    "SELECT * FROM pb_a EXCEPT SELECT s, p, o, o_kind, o_dt, o_lang FROM net WHERE op = 'delete' "
    "UNION SELECT s, p, o, o_kind, o_dt, o_lang FROM net WHERE op = 'insert'")
SQL["page_triples"] = w(QUADS, *expected_ctes("quads", "")) + (
    "SELECT * FROM a ORDER BY s, p, o, o_kind, o_dt, o_lang LIMIT 1000 OFFSET 3000")
BS = "\\"
ESC = (f"replace(replace(replace(replace(o, '{BS}', '{BS}{BS}'), '\"', '{BS}\"'), chr(10), '{BS}n'), "
       f"chr(13), '{BS}r')")
SQL["ntriples_export"] = w(QUADS) + (
    "SELECT DISTINCT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'uri' THEN '<' || o || '>' ELSE "
    "'\"' || " + ESC + " || '\"' || CASE WHEN o_dt <> '' THEN '^^<' || o_dt || '>' "
    "WHEN o_lang <> '' THEN '@' || o_lang ELSE '' END END || '.' AS nt FROM quads")
SQL["decode_literals"] = w(QUADS) + (
    f"SELECT DISTINCT s, p, o, CASE WHEN o_dt = {INT_DT} THEN TRY_CAST(o AS BIGINT) END AS int_value, "
    f"CASE WHEN o_dt = {TS_DT} THEN TRY_CAST(o AS TIMESTAMP) END AS ts_value FROM quads WHERE o_dt IN ({INT_DT}, {TS_DT})")
VALUE = (f"COALESCE(CASE o_dt WHEN {INT_DT} THEN CAST(TRY_CAST(o AS HUGEINT) AS VARCHAR) "
         f"WHEN {DEC_DT} THEN CAST(TRY_CAST(o AS DECIMAL(38,12)) AS VARCHAR) ELSE CAST(TRY_CAST(replace(o, 'Z', '') AS TIMESTAMP) AS VARCHAR) END, o)")
RESPELLED = [
    QUADS,
    f"pub AS (SELECT DISTINCT {T} FROM quads WHERE o_dt IN ({INT_DT}, {DEC_DT}, {TS_DT}))",
    f"ch AS (SELECT CASE WHEN {key()} % 3 = 0 THEN 'delete' ELSE 'insert' END AS op, s, p, "
    f"CASE o_dt WHEN {TS_DT} THEN o || '.000Z' WHEN {INT_DT} THEN '+0' || o ELSE '+0' || o || '0' END AS o, o_kind, o_dt, o_lang FROM pub)",
    f"pv AS (SELECT *, {VALUE} AS v FROM pub)",
    f"cv AS (SELECT *, {VALUE} AS v FROM ch)",
]
SQL["logical_literal_equality"] = w(*RESPELLED) + (
    "SELECT op, s, p, o FROM cv c WHERE op = 'delete' AND EXISTS (SELECT 1 FROM pv b WHERE b.s = c.s AND b.p = c.p AND b.o_dt = c.o_dt AND b.v = c.v) "
    "UNION ALL SELECT op, s, p, o FROM cv c WHERE op <> 'delete' AND NOT EXISTS (SELECT 1 FROM pv b WHERE b.s = c.s AND b.p = c.p AND b.o_dt = c.o_dt AND b.v = c.v)")
SQL["logical_delete_applied"] = w(*RESPELLED) + (
    f"SELECT {T} FROM pv b WHERE NOT EXISTS (SELECT 1 FROM cv c WHERE c.op = 'delete' AND b.s = c.s AND b.p = c.p AND b.o_dt = c.o_dt AND b.v = c.v) "
    f"UNION SELECT {T} FROM cv c WHERE c.op = 'insert' AND NOT EXISTS (SELECT 1 FROM pv b WHERE b.s = c.s AND b.p = c.p AND b.o_dt = c.o_dt AND b.v = c.v)")
JOBS = [
    "rng AS (SELECT MIN(ts) AS lo, MAX(ts) AS hi FROM events)",
    "jobs AS (SELECT lo - INTERVAL 1 HOUR AS ts, 'job/initial' AS job_id, 'initialSync' AS job_operation, "
    "'success' AS status FROM rng "
    "UNION ALL SELECT make_timestamp(epoch_us(lo) + (epoch_us(hi) - epoch_us(lo)) // 3), 'job/heal', 'healing', "
    "'scheduled' FROM rng "
    "UNION ALL SELECT make_timestamp(epoch_us(lo) + (epoch_us(hi) - epoch_us(lo)) // 3) + INTERVAL 1 SECOND, "
    "'job/heal', 'healing', 'busy' FROM rng "
    "UNION ALL SELECT make_timestamp(epoch_us(lo) + (epoch_us(hi) - epoch_us(lo)) // 2), 'job/heal', 'healing', "
    "'success' FROM rng)",
    "iv AS (SELECT job_id, job_operation, status, ts AS st, LEAD(ts) OVER (PARTITION BY job_id ORDER BY ts) AS en FROM jobs)",
    "span AS (SELECT event_id // 100 AS msg_id, MIN(ts) AS t0, MAX(ts) AS t1 FROM events GROUP BY event_id // 100)",
]
SQL["gate_messages"] = w(*JOBS) + (
    "SELECT s.msg_id, CASE "
    "WHEN EXISTS (SELECT 1 FROM jobs j WHERE j.status = 'scheduled' AND j.ts BETWEEN s.t0 AND s.t1) THEN 'heal' "
    "WHEN EXISTS (SELECT 1 FROM iv WHERE iv.status IN ('scheduled', 'busy') AND s.t0 >= iv.st "
    "AND (iv.en IS NULL OR s.t0 < iv.en)) THEN 'blocked' "
    "WHEN (SELECT MIN(ts) FROM jobs WHERE job_operation = 'initialSync' AND status = 'success') IS NULL "
    "OR (SELECT MIN(ts) FROM jobs WHERE job_operation = 'initialSync' AND status = 'success') >= s.t0 THEN 'no_sync' "
    "ELSE 'process' END AS decision FROM span s")
SQL["healing_signals"] = "SELECT DISTINCT event_id // 100 AS msg_id FROM events WHERE event_type = 'purchase' AND user_id % 5 IN (0, 1)"
SQL["error_debounce"] = w(
    "e AS (SELECT event_id AS id, ts AS created FROM events WHERE event_type = 'error')",
    "f AS (SELECT *, CASE WHEN created - LAG(created) OVER (ORDER BY created, id) >= INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS brk FROM e)",
    "g AS (SELECT *, SUM(brk) OVER (ORDER BY created, id ROWS UNBOUNDED PRECEDING) AS isl FROM f)",
) + ("SELECT 'default' AS stream, MIN(created) AS first_at, MAX(created) AS last_at, arg_max(id, created) AS last_id, "
     "COUNT(*) AS n_errors FROM g GROUP BY isl")
SQL["in_scope_batch"] = w(QUADS, *reach_ctes("quads", "")) + (
    "SELECT DISTINCT 'urn:r:customer/' || CAST(user_id AS VARCHAR) AS uri, 1 AS rule_no FROM events "
    "WHERE 'urn:r:customer/' || CAST(user_id AS VARCHAR) IN (SELECT node FROM r_c) AND EXISTS (SELECT 1 FROM quads q "
    f"WHERE q.s = 'urn:r:customer/' || CAST(user_id AS VARCHAR) AND q.g <> {PUB})")

SQL["stream_live_flow"] = SQL["live_flow_net"]
SQL["stream_replay"] = SQL["live_flow_net"]
SQL["stream_bare_messages"] = SQL["live_flow_net"]
SQL["stream_debounce"] = SQL["error_debounce"]
SQL["stream_dispatch"] = SQL["dispatch_streams"].replace("SELECT DISTINCT t.msg_id, s.stream FROM", "SELECT stream, msg_id, row_number() OVER (PARTITION BY stream ORDER BY msg_id) - 1 AS place FROM (SELECT DISTINCT t.msg_id, s.stream FROM") + ")"
# status changes k of jobs; trigger i holds the messages from i * step on
STREAM_GATE = [
    EV, CHANGES, "hi AS (SELECT MAX(msg_id) AS m FROM changes)",
    "st AS (SELECT event_id // 350 AS k, event_id // 100 AS msg_id, (event_id // 350) % 6 AS r FROM events WHERE event_id % 350 = 0)",
    "js AS (SELECT k, msg_id, CASE WHEN r <= 1 THEN 'initialSync' WHEN r <= 4 THEN 'healing' ELSE 'export' END AS operation, "
    "CASE r WHEN 0 THEN 'scheduled' WHEN 1 THEN 'success' WHEN 2 THEN 'scheduled' WHEN 3 THEN 'busy' WHEN 4 THEN 'success' ELSE 'busy' END AS status FROM st)",
    "ms AS (SELECT DISTINCT msg_id, msg_id // ((SELECT m FROM hi) // 4 + 1) AS trigger_no FROM (SELECT msg_id FROM changes UNION SELECT msg_id FROM st))",
    "d AS (SELECT m.msg_id, m.trigger_no, CASE WHEN EXISTS (SELECT 1 FROM js j WHERE j.msg_id = m.msg_id AND j.status = 'scheduled' AND j.operation <> 'export') THEN 'heal' "
    "WHEN (SELECT arg_max(status, k) FROM js j WHERE j.msg_id <= m.msg_id AND j.operation = 'healing') IN ('scheduled', 'busy') "
    "OR (SELECT arg_max(status, k) FROM js j WHERE j.msg_id <= m.msg_id AND j.operation = 'initialSync') IN ('scheduled', 'busy') THEN 'blocked' "
    "WHEN NOT EXISTS (SELECT 1 FROM js j WHERE j.msg_id <= m.msg_id AND j.operation = 'initialSync' AND j.status = 'success') THEN 'no_sync' ELSE 'process' END AS decision FROM ms m)"]
SQL["stream_gate"] = SQL["stream_gate_restart"] = w(*STREAM_GATE) + (
    "SELECT msg_id, CASE WHEN decision = 'process' AND EXISTS (SELECT 1 FROM d h WHERE h.trigger_no = d.trigger_no AND h.decision = 'heal' AND h.msg_id > d.msg_id) THEN 'flushed' ELSE decision END AS decision FROM d")
SQL["stream_multi_message"] = SQL["replay_feed"]
SQL["stream_bad_message"] = w(EV, CHANGES) + (
    "SELECT msg_id, NULL AS error, 1 AS n_messages, COUNT(*) AS n_changes FROM changes WHERE msg_id % 10 <> 3 GROUP BY msg_id "
    "UNION ALL SELECT NULL, 'not JSON of a message', COUNT(DISTINCT msg_id), NULL FROM changes WHERE msg_id % 10 = 3 HAVING COUNT(*) > 0")
SQL["heal_report"] = w(*HEAL, DIFF) + (
    "SELECT 'run-1' AS run_id, op, p, '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'uri' THEN '<' || o || '>' ELSE "
    "'\"' || " + ESC + " || '\"' || CASE WHEN o_dt <> '' THEN '^^<' || o_dt || '>' "
    "WHEN o_lang <> '' THEN '@' || o_lang ELSE '' END END || '.' AS nt FROM diff")
