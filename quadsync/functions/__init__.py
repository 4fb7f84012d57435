"""Column expressions on term columns (built-ins only, no UDFs)."""

from quadsync.functions.terms import (  # noqa: F401
    canonical_object,
    date_of_instant,
    decode_literal,
    escape_predicate,
    is_inverse,
    normalize_predicate,
    ntriple,
    serialize_term,
    share_uri,
)
