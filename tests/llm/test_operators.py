"""Operators on small hand-made tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadsync.llm import decontaminate, html_main, jaccard_join, language, line_dedup, mixing, nearest, pii, toxicity, warc
from quadsync.llm.components import star_components
from quadsync.llm.shared import fresh_dir

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, a long, copies int"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); further columns have names that the operators use themselves."""
    full = [(*r, None if r[1] is None else len(r[1]), "x", i, 9) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, DOC).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Texts with nulls, empties, repeated rows, near copies, common lines and passages, and a long one."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 7)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    common = ["This line is found in very many documents.", "  this LINE is found in very many documents.\t", "another common line of text", "short line"]
    rows = []
    for i in range(120):
        text = "\n".join(r.choice([sentence(r.randint(3, 12)), r.choice(common)]) for _ in range(r.randint(1, 6)))
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])))
    base = sentence(80).split()
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = word()
        rows.append((200 + i, " ".join(w), "en", "b"))
    rows += [(300, None, "en", "a"), (301, "", "en", None), (302, " \n\t", "de", "b"), (None, "no id at all in this text here", "en", "c"), (None, None, None, None),
             (5, rows[5][1], rows[5][2], rows[5][3]), (303, sentence(30_000), "en", "a"), (304, "one two", "en", "a"), (305, "ONE two", "en", "a"), (306, "123 456", "en", "a")]
    return rows


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent):
    """(doc_id, text) rows -> component of each, by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return [d if not sets[i] else min(least[root(i)], default=None) for i, (d, _) in enumerate(rows)], sets


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, corpus, k, percent):
    rows = [(r[0], r[1]) for r in corpus]
    want, sets = components(rows, k, percent)
    got = jaccard_join.jaccard_components(docs_of(spark, corpus), k, percent, group_tokens=600, query_tokens=1500).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((d, len(s), c) for (d, _), s, c in zip(rows, sets, want, strict=True))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_of_similar_families(spark, k, percent):
    """Families of texts around the threshold, most pairs just below it, all with one passage in common."""
    r = random.Random(k)
    word = lambda: "".join(r.choice("abdeilnorst") for _ in range(6))
    passage = [word() for _ in range(55)]
    rows = []
    for f in range(12):
        base = [word() for _ in range(r.choice([6, 12, 60, 250]))]
        for i in range(30):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(base) // (12 + f)))):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w + passage if i % 3 == 0 else w)))
    want, sets = components(rows, k, percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for sizes in ({}, {"group_tokens": 900, "query_tokens": 2000, "asked_parts": 300}):
        got = jaccard_join.jaccard_components(docs, k, percent, **sizes).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, want, strict=True))
    assert 20 < len(set(want)) < 300


def test_repeated_ids_are_linked_by_their_own_text(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (2, a + " x"), (2, b), (7, b + " y")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (2, 1), (2, 2), (7, 2)]


def test_star_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)]
    got = {r.a: r.b for r in star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in parent if root(x) != x}


def lines_brute(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in {(d, t) for d, t in rows}:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add((d, t))
    gone = {k: max((d for d, _ in v if d is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in gone and gone[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(spark, corpus, batches):
    got = line_dedup.dedup_lines(docs_of(spark, corpus), batches=batches).select("row.doc_id", "n_lines", "kept").collect()
    want = lines_brute([(r[0], r[1]) for r in corpus])
    assert Counter((r.doc_id, r.n_lines, r.n_lines - len(r.kept), "\n".join(r.kept)) for r in got) == Counter(want)


def test_line_runs_anti_join(spark):
    keys = lambda ids: spark.createDataFrame([(d, d, 0, d % 4, 7) for d in ids], "doc_id long, text_hash long, pos int, h1 long, h2 long")
    runs = line_dedup.LineRuns(spark)
    assert runs.fresh(keys([1, 2])).count() == 2
    for ids in ([1, 2], [3, 5], [2, 6], [9]):
        runs.add(keys(ids))
    assert {r.h1 for r in runs.fresh(keys([4, 1, 2, 3])).collect()} == {0}
    assert sorted((r.h1, r.n, r.holder) for r in runs.known().collect()) == [(1, 3, 9), (2, 3, 6), (3, 1, 3)]


def targets_brute(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * w[s] / share > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: cap * sizes[s] if s in full else rest * w[s] / share for s in order}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, "d": 3, "é": 700, None: 40}, {"a": 1, "b": 1}, {"x": 5}, {"a": 0, "b": 9, "c": 100}, {None: 0}])
def test_source_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = targets_brute(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    assert got == pytest.approx(want)


def test_mixing(spark, corpus):
    docs = docs_of(spark, corpus)
    m = mixing.mix_sources(docs).collect()
    assert len(m) == len(corpus) and all(r.copies <= 3 and (r.size == 0 or r.rate <= 3) for r in m)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in m)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == sum((Counter({r.doc_id: r.copies}) for r in m), Counter())
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mixed_documents(docs).collect()))


def test_mixing_comes_near_the_targets(spark):
    rows = [(i, "w " * (1 + i % 50), "en", "abcd"[i % 4]) for i in range(4000)]
    m = mixing.mix_sources(docs_of(spark, rows)).collect()
    taken, target, variance = Counter(), {}, Counter()
    for r in m:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        variance[r.source] += r.size ** 2 * (r.rate % 1) * (1 - r.rate % 1)
    assert all(abs(taken[s] - t) < 4 * variance[s] ** 0.5 for s, t in target.items())


def plant(rows, item):
    w = item.split()
    swap = list(w)
    for i in range(4, len(w), 7):
        swap[i] = "changed"
    return [*rows, (900, "before it " + item + " after it", "en", "a"), (901, "start " + " ".join(swap).upper() + ", end", "en", "a"), (902, "x " + " ".join(w[5:19]) + " y", "en", "b"),
            (903, "x " + " ".join(w[5:13]) + " y", "en", "b"), (904, " ".join(reversed(w)), "en", "b"), (900, "before it " + item + " after it", "en", "a")]


def test_decontamination(spark, corpus):
    r = random.Random(8)
    item = " ".join("".join(r.choice("xyzuvw") for _ in range(6)) for _ in range(30))
    bench = spark.createDataFrame([(1, item), (2, "seldom seen words"), (3, None), (4, ""), (None, "not in any of them at all, this is nowhere to be found")], "item_id long, text string")
    rows = [*plant(corpus, item), (905, "these are Seldom, seen WORDS here", "en", "a")]
    got = Counter((x.doc_id, x.item_id) for x in decontaminate.contamination(docs_of(spark, rows), bench).collect())
    assert got == Counter({(900, 1): 2, (901, 1): 1, (902, 1): 1, (905, 2): 1})


def test_decontamination_with_a_word_substituted_anywhere(spark):
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(9, 17)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    cases = [(n, (i,)) for n in items for i in range(n)] + [(12, (5, 6)), (15, (3, 7, 11)), (15, (0, 1, 14)), (11, (0, 10))]
    few = [(9, (0, 8)), (14, (5, 6, 7)), (15, (2, 6, 8, 12))]
    rows = []
    for k, (n, bad) in enumerate(cases + few):
        rows.append((k, "so " + " ".join("other" if i in bad else w for i, w in enumerate(items[n])) + " it goes", "en", "a"))
    got = Counter((x.doc_id, x.item_id) for x in decontaminate.contamination(docs_of(spark, rows), bench).collect())
    assert got == Counter({(k, n): 1 for k, (n, _) in enumerate(cases)})


def test_decontamination_by_short_items(spark):
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(1, 9)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    cases = [(n, ()) for n in items] + [(n, (i,)) for n in range(5, 9) for i in range(n)]
    few = [(n, (i,)) for n in range(1, 5) for i in range(n)] + [(n, (0, n - 1)) for n in range(5, 9)]
    rows = [(k, "so " + " ".join("other" if i in bad else w for i, w in enumerate(items[n])) + " it goes", "en", "a") for k, (n, bad) in enumerate(cases + few)]
    got = Counter((x.doc_id, x.item_id) for x in decontaminate.contamination(docs_of(spark, rows), bench).collect())
    assert got == Counter({(k, n): 1 for k, (n, _) in enumerate(cases)})


def test_language(spark, corpus):
    r = random.Random(9)
    say = {"en": "the of and to in is that for it was on are with as", "de": "der die und das ist nicht ein zu von mit auf für dem", "fr": "le la les des est une dans que pour qui pas sur au é è"}
    rows = [(1000 + i, " ".join(r.choice(say[x].split()) for _ in range(r.randint(5, 40))), x, "s") for i, x in enumerate(["en", "de", "fr"] * 120)]
    rows += [(2000, None, "en", "s"), (2001, "12 34 !?", "de", "s"), (2002, "", None, None), (None, "the of and to in is", None, None)]
    d = docs_of(spark, rows)
    out = language.identify(d, d.where(language.fold(d.doc_id) != 1), d.doc_id, d.schema["doc_id"].dataType).collect()
    assert len(out) == len(rows)
    got = {x.row: (x.lang_pred, x.score) for x in out}
    assert {got[i][0] for i in (2000, 2001, 2002)} == {"und"} and got[None][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    held = [(i, x) for i, _, x, _ in rows[:360] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i][0] == x for i, x in held) >= 0.99 * len(held)


def test_rare_languages_are_learned_from_many_rows(spark):
    ids = spark.range(50_000)
    unit = mixing.hash_unit("language-sample", ids.id)
    rare = ids.orderBy(unit.desc()).first().id
    labelled = ids.selectExpr("id AS doc_id", f"if(id = {rare}, 'ŋa ŋwa', 'the of and') AS text", f"if(id = {rare}, 'ww', 'en') AS lang")
    langs, logs = language.fit(labelled)
    assert langs == ["en", "ww"] and np.allclose(np.exp(logs[-1]), [50_000 / 50_002, 2 / 50_002])


def test_toxicity_learns_words_and_sees_through_disguise(spark):
    r = random.Random(4)
    bad = ["idiot", "moron", "clown", "stupid", "trash"]
    disguise = {"idiot": ["1d10t", "i d i o t", "idioooot"], "moron": ["m0r0n", "m.o.r.o.n"], "clown": ["cl0wn"], "stupid": ["$tup1d"], "trash": ["tr@sh"]}
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ing", "ti"]) for _ in range(r.randint(1, 3)))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(r.randint(5, 60))]
        if i % 5 == 0:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(i % 5 == 0)))
    hidden = []
    for i in range(60):
        b = bad[i % 5]
        w = [word() for _ in range(20)]
        w.insert(7, r.choice(disguise[b]))
        rows.append((5000 + i, " ".join(w), "en", "s"))
        hidden.append(5000 + i)
    rows += [(9000, None, None, None), (9001, "", None, None), (None, "the an re", None, None)]
    lab = spark.createDataFrame([*labels, (0, None), (77_777, 1), (None, 1)], "doc_id long, toxic int").where("doc_id IS NULL OR doc_id % 4 <> 2")
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs_of(spark, rows), lab).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(900) if i % 4 == 2]
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert sum(got[i] >= 0.3 for i in hidden) >= 0.9 * len(hidden)
    assert got[9000] == got[9001] < 0.3


def test_toxicity_without_labels(spark, corpus):
    lab = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.score < 1e-9 for x in toxicity.toxicity(docs_of(spark, corpus), lab).collect()} == {True}


def test_personal_data(spark, corpus):
    rows = [*corpus, (700, "mail a@b.co and jane (at) example (dot) com", "en", "a")]
    out = {x.doc_id: x for x in pii.find_personal_data(docs_of(spark, rows)).collect()}
    assert out[700].n_email == 1 and out[700].spans == "email:5:11,email:16:43" and out[700].n_added == 1
    assert out[700].base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    assert out[300].spans == "" and out[301].base_sha256 == hashlib.sha256(b"").hexdigest()


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "page_id long, url string, html string, sum long, path string").repartition(3)


def test_warc_round_trip(spark):
    rows = [(i, f"http://e/{i}", f"<p>{'pé' * (i % 7)}</p>") for i in range(60)] + [(70, None, None), (71, "u", ""), (None, "n", "<p></p>"), (None, "n", "alone"), (72, "v", "once"), (72, "v", "once"), (73, "v", "once")]
    archives = warc.write_warc(pages_of(spark, rows), fresh_dir(spark, "test-warc"))
    got = warc.read_warc(archives, split_bytes=700).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and i != f
        want.append((i, len(b), warc.base32_sha1(b), "revisit" if again else "response", f if again else None))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)


def test_main_text_of_pages(spark):
    model = html_main.train(html_main.labelled_pages(150))
    rows = [(1, "u", "<body><nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>Text &amp; more.</p></article></body>"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>Other text.</p></article>")]
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html_main.extract_main(pages_of(spark, rows), model).collect())
    assert got == Counter([(1, "u", "Head\nText & more.", 17), (2, None, "", 0), (None, "u", "", 0), (1, "u", "Other text.", 11)])


def test_nearest_recall_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16))
    x[300:700] = x[300]
    x[1000:] *= r.uniform(0.5, 2, (500, 1))
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] + [1.0] * 15, 1), (2060, [None] + [1.0] * 15, 1), (2080, [1.0, 2.0], 1), (2081, [2.0, 1.0], 1), (2082, [], 1),
             (None, [1.0] * 16, 1), rows[40], rows[41]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector int")
    got = defaultdict(list)
    for q in nearest.nearest(v, v.vec_id % 20 == 0, part_rows=400, at_once=30).orderBy("query_id", "rank").collect():
        got[q.query_id].append((q.vec_id, q.score))
    x = x.astype(np.float32).astype(float)
    ids, hit, total = np.arange(1500), 0, 0
    for i in range(0, 1500, 20):
        s = nearest.in_order_dot(x, x[i])
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        found = dict(got[i])
        assert len(got[i]) == 20 and all(found[j] == s[j] for j in found)
        hit += len(set(best.tolist()) & set(found))
        total += 20
    assert hit >= 0.9 * total
    ties = [j for j, _ in got[320] if 300 <= j < 700]
    assert ties and ties == [*range(300, 300 + len(ties))]
    assert got[2080] == [(2081, 4.0)]
    assert set(got) == {*range(0, 1500, 20), 2080}


def test_nearest_verifies_few_points_of_clusters(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(100, 64))
    x = centre[r.integers(0, 100, 4000)] + 0.3 * r.normal(size=(4000, 64))
    top, limit = float((x * x).sum(1).max()), nearest.chi_square_quantile(nearest.STOP, nearest.DIMS)
    space = nearest.Space(nearest.DIMS, 1.0, top)
    points, ids = space.points(x), np.arange(4000)
    part = nearest.Part(x, ids, points)
    for i in range(0, 4000, 40):
        part.search(x[i], space.points(x[i:i + 1], is_query=True)[0], i, 20, top, limit, -np.inf)
    assert part.verified < 0.3 * 100 * 4000
    # the parts of the whole table: a query goes to few of them, and finds its neighbours
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for q in nearest.nearest(v, v.vec_id % 40 == 0, part_rows=250).collect():
        got[q.query_id].add(q.vec_id)
    hit = 0
    for i in range(0, 4000, 40):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(got[i] & set(np.argsort(-s)[:20].tolist()))
    assert hit >= 0.9 * 20 * 100


def test_nearest_scale_does_not_matter(spark):
    x = np.random.default_rng(4).normal(size=(300, 8))
    for unit in (2.0 ** 500, 2.0 ** -500):
        v = spark.createDataFrame([(i, (row * unit).tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
        got = nearest.nearest(v, v.vec_id % 20 == 0, k=5).toPandas()
        assert len(got) == 75
        hit = sum(r.vec_id in np.argsort(-np.where(np.arange(300) == r.query_id, -np.inf, x @ x[r.query_id]))[:5] for r in got.itertuples())
        assert hit >= 0.9 * 75


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    some = docs_of(spark, [(1, "a few words in a text", "en", "a")])
    results = [jaccard_join.jaccard_components(docs), line_dedup.dedup_lines(docs), mixing.mix_sources(docs), mixing.mixed_documents(docs), pii.find_personal_data(docs),
               toxicity.toxicity(docs, labels), decontaminate.contamination(docs, bench), decontaminate.contamination(some, bench), nearest.nearest(vectors, vectors.vec_id % 20 == 0),
               language.identify(docs, docs, docs.doc_id, docs.schema["doc_id"].dataType), html_main.extract_main(pages, html_main.train(html_main.labelled_pages(60))),
               warc.read_warc(warc.write_warc(pages, fresh_dir(spark, "test-warc")))]
    assert [r.count() for r in results] == [0] * len(results)
    out = language.identify(some, docs, some.doc_id, docs.schema["doc_id"].dataType).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


def test_a_group_of_many_askers_is_compared_in_little_memory():
    """pipeline, near_duplicates: arrays of cells took hundreds of MB of a task."""
    import tracemalloc

    import pyarrow as pa

    from quadsync.llm.jaccard_join import part_matrix

    m, parts = 4000, 30
    names = [{"run": r * 2, "odd": False, "times": 1} for r in range(parts)]
    t = pa.table({"g": pa.array([1] * m), "part": pa.array([0] * m, pa.int32()), "rep": pa.array(range(m)), "sid": pa.array(range(m)), "n": pa.array([100] * m),
                  "need0": pa.array([parts] * m), "need1": pa.array([0] * m), "member": pa.array([i % 2 == 0 for i in range(m)]),
                  "parts": pa.array([names] * m, pa.list_(pa.struct([("run", pa.int64()), ("odd", pa.bool_()), ("times", pa.int64())])))})
    tracemalloc.start()
    kept = part_matrix(80)(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept.num_rows == m and peak < 96 << 20
