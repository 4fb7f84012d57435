"""quadsync: keep a rule-scoped publication of a quad graph in sync, on Spark.

Everything is a DataFrame job over one quad table ``(g, s, p, o, o_kind,
o_dt, o_lang, o_key)``: scope by type, graph and path to a scheme node
(joins), expected-vs-published diffs (anti joins), rewriting of change
messages into publication changes (frontier loops of joins), folding,
chunked JSON change files and a manifest feed.
"""

from quadsync.vocab import RDF_TYPE, XSD_DATETIME, XSD_DECIMAL, XSD_INTEGER  # noqa: F401
