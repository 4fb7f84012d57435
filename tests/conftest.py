import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("QUADSYNC_SCRATCH", tempfile.mkdtemp(prefix="quadsync-test-"))
    from quadsync.session import local_session

    s = local_session("*", shuffle_partitions=8, app="quadsync-tests")
    yield s
    s.stop()


@pytest.fixture
def mk(spark):
    """Build a quad DataFrame from short tuples (g, s, p, o[, kind, dt, lang])."""
    from quadsync.sources.tables import with_key
    from quadsync.vocab import QUAD_COLS

    def build(rows):
        full = []
        for r in rows:
            g, s, p, o, *rest = r
            kind = rest[0] if len(rest) > 0 else ("uri" if o.startswith("urn:") else "literal")
            dt = rest[1] if len(rest) > 1 else ""
            lang = rest[2] if len(rest) > 2 else ""
            full.append((g, s, p, o, kind, dt, lang))
        df = spark.createDataFrame(full, "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")
        return with_key(df).select(*QUAD_COLS)
    return build
