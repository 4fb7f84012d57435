"""The pipeline against brute force on a small corpus, and the registered queries against their SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadsync.llm import catalog, mixing
from quadsync.llm.mixing import hash_unit

from .test_operators import components, lines_brute, targets_brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    r = random.Random(12)
    say = {"en": "the of and to in is that for it was on are with as", "de": "der die und das ist nicht ein zu von mit auf dem"}
    text = lambda x, n: " ".join("".join(r.choice(say[x].split()) for _ in range(r.randint(1, 3))) for _ in range(n))
    item = text("en", 25)
    rows = []
    for i in range(150):
        x = r.choice(["en", "de"])
        lines = [text(x, r.randint(4, 25)) for _ in range(r.randint(1, 3))]
        if i % 4 == 0:
            lines.insert(1, "Some common line in many documents here")
        if i % 25 == 3:
            lines.append("and then " + item.upper() + " so")
        rows.append((i, "\n".join(lines), x, r.choice(["a", "b", "c", None])))
    for i in range(25):
        w = rows[7][1].split(" ")
        w[r.randrange(len(w))] = "other"
        rows.append((400 + i, " ".join(w), "en", "b"))
    rows += [(500, None, "en", "a"), (501, "", "en", "a"), (502, "12 34", "en", "a"), (None, "no id but " + text("en", 12), "en", "a"), rows[9]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*x, None if x[1] is None else len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item


def brute(spark, rows, item):
    rows = [x for x in rows if x[1] and re.search(r"[^\W\d_]", x[1])]
    rows = [(d, new, lang, source) for (d, _, lang, source), (_, _, _, new) in zip(rows, lines_brute([(x[0], x[1]) for x in rows]), strict=True)]
    ids, sets = components([(-1 - zlib.crc32(x[1].encode()) if x[0] is None else x[0], x[1]) for x in rows], 5, 80)
    rows = [x for x, c, s in zip(rows, ids, sets, strict=True) if not s or c == x[0] or x[0] is None]
    rows = list({(x[0], x[1]): x for x in rows}.values())
    norm = lambda t: " ".join(re.findall(r"[a-z0-9]+", t.lower()))
    rows = [x for x in rows if norm(item) not in norm(x[1])]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = Counter()
    for x in rows:
        sizes[x[3]] += size(x[1])
    target = targets_brute(sizes)
    ids = spark.createDataFrame([(x[0],) for x in rows], "doc_id long")
    unit = {x.doc_id: x.u for x in ids.select("doc_id", hash_unit(mixing.SEED, F.col("doc_id")).alias("u")).collect()}
    out = Counter()
    for x in rows:
        rate = target[x[3]] / sizes[x[3]]
        out[(*x, len(x[1]))] += int(rate) + (unit[x[0]] < rate - int(rate))
    return +out


def test_pipeline_matches_brute_force(spark, corpus):
    folder, rows, item = corpus
    got = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == brute(spark, rows, item)


def test_stages_keep_columns_and_clean_documents(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS row", "'x' AS kept", "2 AS gone")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_on_empty_documents(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_near_duplicates_drop_by_id_and_text(spark):
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, unique, other = words(60), words(50), words(40)
    rows = [(1, a, {"k": 1}), (2, a + " more", {"k": 2}), (2, unique, {"k": 3}), (3, other, {"k": 4}), (3, other + " x", {"k": 5}),
            (4, unique + " y", {"k": 6}), (5, words(30), {"k": 7}), (5, None, {"k": 8}), (5, None, {"k": 9}), (None, words(20), None), (6, "", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, int>")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert out.schema == docs.schema
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=str)
    one = [t for d, t in got if d == 3]
    assert len(one) == 1 and one[0] in (other, other + " x")
    assert [x for x in got if x[0] != 3] == sorted([(1, a), (2, unique), (5, rows[6][1]), (5, None), (None, rows[9][1]), (6, "")], key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SMALL)
    want = con.execute(catalog.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(map(value, r)) for r in df.select(*cols).collect()) == Counter(tuple(map(value, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_pii", "op2_toxicity", "op3_html_main", "op6_nearest", "op8_jaccard_join", "op10_language"])
def test_other_queries_return_their_rows(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    rows = df.collect()
    documents, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "pages"))
    if name == "op3_html_main":
        assert len(rows) == pages.count()
    elif name == "op6_nearest":
        assert {r["rank"] for r in rows} == {*range(1, 21)}
    else:
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    if name == "op8_jaccard_join":
        texts = [(r.doc_id, r.text) for r in documents.collect()]
        want, sets = components(texts, 4, 85)
        assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(d, len(s), c) for (d, _), s, c in zip(texts, sets, want, strict=True)}
    if name == "op10_language":
        truth = {r.doc_id: r.lang for r in documents.collect()}
        held = [r for r in rows if r.held_out]
        assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
