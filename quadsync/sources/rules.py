"""Export rules.

A rule says which resources belong to the publication: a type, the
properties to copy, the allowed source graphs (list or regexes), an
optional filter, an optional strict type, and a path of predicates from
the resource to the concept scheme node. Rules are configuration: tens to
hundreds of rows. They are the only thing held on the driver, and the
size bound is checked before they are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadsync.vocab import CONCEPT_SCHEME, PUBLICATION_GRAPH, RDF_TYPE, XSD_DATETIME, XSD_DECIMAL, XSD_INTEGER

MAX_RULES = 10_000  # bound for broadcasting the rule tables


@dataclass(frozen=True)
class ExportRule:
    rule_no: int
    type: str
    properties: tuple[str, ...]
    path: tuple[str, ...] = ()
    graphs: tuple[str, ...] = ()
    graphs_regex: bool = False
    # Filter on the subject, two forms: a Spark SQL boolean over the quad
    # columns s, p, o, g of the candidate triple, and/or patterns
    # ``?subject <p> ?o FILTER(cond)``: (p, SQL condition over o / o_key /
    # o_dt / o_lang) that must hold for some triple of the subject, any graph.
    filter_expr: str | None = None
    filter_patterns: tuple[tuple[str, str], ...] = ()
    strict: bool = False
    stream: str = "default"

    @property
    def has_filter(self) -> bool:
        return bool(self.filter_expr) or bool(self.filter_patterns)

    @property
    def all_properties(self) -> tuple[str, ...]:
        """Configured properties plus rdf:type, deduplicated, in order."""
        out = list(dict.fromkeys(self.properties))
        if RDF_TYPE not in out:
            out.append(RDF_TYPE)
        return tuple(out)


@dataclass(frozen=True)
class ExportSpec:
    rules: tuple[ExportRule, ...]
    concept_scheme: str | None = CONCEPT_SCHEME
    publication_graph: str = PUBLICATION_GRAPH
    stream: str = "default"
    # Reference behaviours that can be switched.
    heal_inverse: bool = False     # Q5: healing skips ^p properties
    pub_in_store: bool = False     # Q1: publication rows visible to scope
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        if len(self.rules) > MAX_RULES:
            raise ValueError(f"{len(self.rules)} rules exceed the broadcast bound {MAX_RULES}")

    def rule(self, rule_no: int) -> ExportRule:
        for r in self.rules:
            if r.rule_no == rule_no:
                return r
        raise KeyError(rule_no)

    def forward_properties(self) -> list[str]:
        return sorted({p for r in self.rules for p in r.all_properties if not p.startswith("^")})

    def inverse_properties(self) -> list[str]:
        return sorted({p[1:] for r in self.rules for p in r.all_properties if p.startswith("^")})

    def path_predicates(self) -> list[str]:
        return sorted({s.lstrip("^") for r in self.rules for s in r.path})

    def types(self) -> list[str]:
        return sorted({r.type for r in self.rules})

    def children(self, rule: ExportRule) -> list[ExportRule]:
        """Rules whose path is this rule's path with one step in front."""
        return [c for c in self.rules
                if len(c.path) == len(rule.path) + 1 and c.path[1:] == rule.path]


# ---------------------------------------------------------------- DataFrames

RULE_SCHEMA = T.StructType([
    T.StructField("stream", T.StringType()),
    T.StructField("rule_no", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.ArrayType(T.StringType())),
    T.StructField("path", T.ArrayType(T.StringType())),
    T.StructField("graphs", T.ArrayType(T.StringType())),
    T.StructField("graphs_regex", T.BooleanType()),
    T.StructField("filter", T.StringType()),
    T.StructField("strict", T.BooleanType()),
    T.StructField("concept_scheme", T.StringType()),
])

#: A condition on some triple ``?subject <predicate> ?o``, as data.
CONDITION = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("predicate", "compare", "value", "datatype")]))
COMPARES = ("exists", "=", "!=", "<", "<=", ">", ">=", "contains", "startsWith")


def rules_frame(spark: SparkSession, spec: ExportSpec) -> DataFrame:
    rows = [(r.stream, r.rule_no, r.type, list(r.properties), list(r.path), list(r.graphs),
             r.graphs_regex, r.filter_expr, r.strict, spec.concept_scheme) for r in spec.rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rule_props_frame(spark: SparkSession, spec: ExportSpec, include_inverse: bool = True) -> DataFrame:
    """(rule_no, type, prop, p, inverse, strict): one row per rule and property."""
    rows = []
    for r in spec.rules:
        for prop in r.all_properties:
            inv = prop.startswith("^")
            if inv and not include_inverse:
                continue
            rows.append((r.rule_no, r.type, prop, prop.lstrip("^"), inv, r.strict))
    schema = "rule_no int, type string, prop string, p string, inverse boolean, strict boolean"
    return spark.createDataFrame(rows, schema)


def rule_types_frame(spark: SparkSession, spec: ExportSpec) -> DataFrame:
    """(type, rule_no, first_step): rules by type, for type-cache joins."""
    rows = [(r.type, r.rule_no, r.path[0] if r.path else None) for r in spec.rules]
    return spark.createDataFrame(rows, "type string, rule_no int, first_step string")


def child_rules_frame(spark: SparkSession, spec: ExportSpec) -> DataFrame:
    """(parent_rule, child_rule, child_type, child_first_step): J7 pairs."""
    rows = [(r.rule_no, c.rule_no, c.type, c.path[0]) for r in spec.rules for c in spec.children(r)]
    return spark.createDataFrame(rows, "parent_rule int, child_rule int, child_type string, child_first_step string")


# ------------------------------------------------------ config files

CONFIG_SCHEMA = T.StructType([
    T.StructField("stream", T.StringType()),
    T.StructField("conceptScheme", T.StringType()),
    T.StructField("export", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.ArrayType(T.StringType())),
        T.StructField("pathToConceptScheme", T.ArrayType(T.StringType())),
        T.StructField("graphsFilter", T.ArrayType(T.StringType())),
        T.StructField("hasRegexGraphsFilter", T.BooleanType()),
        T.StructField("additionalFilter", T.StringType()),
        T.StructField("filters", CONDITION),
        T.StructField("strictTypeExport", T.BooleanType()),
    ]))),
])


def explode_config(config: DataFrame) -> DataFrame:
    """Config documents (one per stream) -> one row per rule with defaults."""
    stream = F.coalesce(F.col("stream"), F.lit("default")) if "stream" in config.columns else F.lit("default")
    x = config.select(stream.alias("stream"), F.col("conceptScheme").alias("concept_scheme"),
                      F.posexplode_outer("export").alias("rule_no", "r"))
    empty = F.array().cast("array<string>")
    return x.select(
        "stream", F.col("rule_no").cast("int").alias("rule_no"), F.col("r.type").alias("type"),
        F.col("r.properties").alias("properties"),
        F.coalesce("r.pathToConceptScheme", empty).alias("path"),
        F.coalesce("r.graphsFilter", empty).alias("graphs"),
        F.coalesce("r.hasRegexGraphsFilter", F.lit(False)).alias("graphs_regex"),
        F.col("r.additionalFilter").alias("filter"), F.coalesce("r.filters", F.array().cast(CONDITION)).alias("filters"),
        F.coalesce("r.strictTypeExport", F.lit(False)).alias("strict"),
        "concept_scheme",
    )


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return explode_config(spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path))


def rule_violations(rules: DataFrame) -> DataFrame:
    """S6/S7/Q16 checks as rows ``(stream, rule_no, violation)``; empty = valid.

    Errors: no rules in a stream, no type, path without concept scheme,
    no properties. Warning (Q16): two rules of one type with different paths.
    """
    r = rules
    checks = (
        F.when(F.col("rule_no").isNull(), F.lit("no rules"))
    )
    filters = F.col("filters") if "filters" in r.columns else F.array().cast(CONDITION)

    def unknown(c):
        numeric = c["compare"].isin("<", "<=", ">", ">=") & c["datatype"].isin(XSD_INTEGER, XSD_DECIMAL) & c["value"].try_cast("decimal(38,9)").isNull()
        return c["predicate"].isNull() | c["compare"].isNull() | ~c["compare"].isin(*COMPARES) | ((c["compare"] != "exists") & c["value"].isNull()) | numeric
    base = r.select("stream", "rule_no", F.array_compact(F.array(
        checks,
        F.when(F.col("rule_no").isNotNull() & (F.col("type").isNull() | (F.col("type") == "")), F.lit("no type")),
        F.when((F.size("path") > 0) & F.col("concept_scheme").isNull(), F.lit("path without concept scheme")),
        F.when(F.col("rule_no").isNotNull() & (F.coalesce(F.size("properties"), F.lit(0)) <= 0), F.lit("no properties")),
        F.when(F.col("filter").isNotNull(), F.lit("filter is text: give its conditions as filters")),
        F.when(F.exists(filters, lambda c: F.coalesce(unknown(c), F.lit(True))), F.lit("unknown condition in filters")),
    )).alias("v")).select("stream", "rule_no", F.explode("v").alias("violation"))
    a, b = r.alias("a"), r.alias("b")
    paths = (a.join(b, (F.col("a.stream") == F.col("b.stream")) & (F.col("a.type") == F.col("b.type"))
                    & (F.col("a.rule_no") < F.col("b.rule_no")) & (F.col("a.path") != F.col("b.path")))
             .select(F.col("b.stream").alias("stream"), F.col("b.rule_no").alias("rule_no"),
                     F.lit("warning: same type, other path").alias("violation")))
    return base.unionByName(paths)


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def condition_sql(compare: str, value: str | None, datatype: str | None) -> str:
    """The condition on a triple's object as a Spark SQL expression over ``o``; numbers and times by value."""
    if compare == "exists":
        return "true"
    if compare in ("contains", "startsWith"):
        return f"{compare.lower()}(o, {sql_text(value)})"
    kind = {XSD_INTEGER: "decimal(38,9)", XSD_DECIMAL: "decimal(38,9)", XSD_DATETIME: "timestamp"}.get(datatype or "")
    if kind is None:
        return f"o {compare} {sql_text(value)}"
    return f"try_cast(o AS {kind}) {compare} try_cast({sql_text(value)} AS {kind})"


def spec_from_frame(rules: DataFrame, stream: str = "default", **kw) -> ExportSpec:
    """Bring one stream's validated rules to the driver (bounded, checked)."""
    bad = rule_violations(rules.where(F.col("stream") == stream)).where(~F.col("violation").startswith("warning"))
    if not bad.isEmpty():
        raise ValueError(f"invalid rules: {bad.limit(20).collect()}")
    sel = rules.where(F.col("stream") == stream)
    rows = sel.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError("too many rules to hold on the driver")
    scheme = rows[0]["concept_scheme"] if rows else None
    conditions = [tuple((c["predicate"], condition_sql(c["compare"], c["value"], c["datatype"])) for c in (x["filters"] if "filters" in rules.columns else ())) for x in rows]
    out = tuple(ExportRule(rule_no=x["rule_no"], type=x["type"], properties=tuple(x["properties"]),
                           path=tuple(x["path"]), graphs=tuple(x["graphs"]), graphs_regex=x["graphs_regex"],
                           filter_patterns=c, strict=x["strict"], stream=stream) for x, c in zip(rows, conditions, strict=True))
    return ExportSpec(rules=out, concept_scheme=scheme, stream=stream, **kw)
