"""Parts that need no Spark: array primitives, detectors, page trees, archives, decoding."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quadsync.llm import pii, toxicity, warc
from quadsync.llm.decontaminate import best_run, longest_run, seeds, short_seeds, word_hashes
from quadsync.llm.html_labelled import labelled_pages
from quadsync.llm.html_main import TRAIN_PAGES, main_text, node_labels, train
from quadsync.llm.html_tree import parse
from quadsync.llm.jaccard_join import part_hashes
from quadsync.llm.language import code_points, ngrams
from quadsync.llm.nearest import chi_square_quantile, kd_leaves
from quadsync.llm.text_arrays import buffers, pieces, shingle_sets


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_shingle_sets_match_plain_python():
    r = random.Random(1)
    words = ["a", "B", "éÉ", "zz top", "x" * 40, "日本", "c,d"]
    texts = ["".join(r.choice(words) + r.choice([" ", "\n", "\t", "  ", "\x0b"]) for _ in range(r.randint(0, 30))) for _ in range(200)] + [None, "", " ", "A a A a A a", "one"]
    col = pa.array(texts)
    got = {i: len(s) for i, s in shingle_sets(col, 4)}
    assert got == {i: len(shingles(t, 4)) for i, t in enumerate(texts)}
    sliced = {i: len(s) for i, s in shingle_sets(col.slice(50, 20), 4)}
    assert sliced == {i: got[50 + i] for i in range(20)}
    same = {i: s.tobytes() for i, s in shingle_sets(pa.array(["A b c d e", "a B  c\nd e"]), 4)}
    assert same[0] == same[1]


def test_pieces_cover_all_rows():
    _, off = buffers(pa.array(["x" * n for n in (5, 0, 100, 1, 1, 300, 0)]))
    got = list(pieces(off, 50))
    assert got[0][0] == 0 and got[-1][1] == 7 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("percent", [85, 80])
def test_linked_sets_share_a_part(percent):
    r = np.random.default_rng(percent)
    for n in [6, 7, 9, 12, 15, 20, 33, 50, 100, 101, 517, 2000]:
        for _ in range(60):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = r.integers(0, n // 6 + 1)
            b = np.concatenate([a[drop:], r.integers(0, 1 << 63, r.integers(0, n // 6 + 1), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and a.tobytes() != b.tobytes():
                (x, need_x), (y, need_y) = part_hashes(a, percent), part_hashes(b, percent)
                shared = np.bincount((np.intersect1d(x, y) & np.uint64(1)).astype(int), minlength=2)
                assert any(need_x[c] and need_y[c] and shared[c] >= max(need_x[c], need_y[c]) for c in (0, 1))


def base_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


def test_base_detectors_match_the_patterns():
    r = random.Random(2)
    for _ in range(6000):
        x = "".join(r.choice("ab1234567890@@..--  ++()é_%") for _ in range(r.randint(0, 60)))
        assert pii.detect(x) == base_spans(x), x
    x = "card 4111 1111 1111 1111 and 4111-1111-1111-1111, +1 (555) 123-4567, 10.0.0.256, 1.2.3.4.5.6.7.8"
    assert pii.detect(x) == base_spans(x)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("write jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
    ("jane at example dot com.", "email", "jane at example dot com"),
    ("write jane at firma dot dk now", "email", "jane at firma dot dk"),
    ("to jane dot doe at example dot com ok", "email", "jane dot doe at example dot com"),
    ("jane [dot] doe [at] example [dot] org", "email", "jane [dot] doe [at] example [dot] org"),
    ("mail j a n e @ example.com please", "email", "j a n e @ example.com"),
    ("hans klammeraffe firma punkt de", "email", "hans klammeraffe firma punkt de"),
    ("mail jаne@exаmple.com here", "email", "jаne@exаmple.com"),
    ("ja​ne@example.com", "email", "ja​ne@example.com"),
    ("jane @ example . com", "email", "jane @ example . com"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
    ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ("ip 192 dot 168 dot 1 dot 7 end", "ip", "192 dot 168 dot 1 dot 7"),
    ("one nine two dot one six eight dot one dot seven", "ip", "one nine two dot one six eight dot one dot seven"),
])
def test_disguised_data_is_found_at_its_source_characters(text, kind, span):
    _, added = pii.spans_of(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in added] == [(kind, span)]


def test_rows_with_any_span_are_read():
    r = random.Random(7)
    bits = ["jane", "at", "(at)", "[ at ]", "dot", "(dot)", "[.]", "@", " @ ", ".", "example", "com", "five", "FIVE", "null", "Fünf", "FÜNF", "plus", "+", "1", "192", "555-1234", "а", "４", " ", "\n", ", ", "_at_", "one one"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " ", "-"]) for _ in range(r.randint(0, 16))) for _ in range(6000)]
    texts += ["plus one five five five one two three four five six seven", "jane at example dot com", "jane (at) example.com", "user_at_example_dot_com", "five-five-five-one-two-three-four-five-six-seven", None, ""]
    worth = pii.worth_reading(pa.array(texts))
    assert not [t for t, w in zip(texts, worth, strict=True) if not w and any(pii.spans_of(t or ""))]
    assert not pii.worth_reading(pa.array(["Plain words without anything, nothing at all.", "un mot et un autre", None, ""])).any()


@pytest.mark.parametrize("text", ["look at home . The end", "look at the dot on it", "one two three", "un deux trois", "sits at home.the end", "meet me at noon dot", "", "café at 5.30", "we are at this point in time", "a red dot at noon dot is", "look at example.com"])
def test_plain_texts_have_no_disguised_data(text):
    assert pii.spans_of(text) == ([], [])


@pytest.mark.parametrize("text", [" " * 200_000 + "@ x", "1" * 200_000, "a" * 200_000 + "@", "@" * 100_000, "one " * 50_000, "1." * 50_000, "(at) " * 40_000, "a " * 100_000 + "@ x.com", "a dot " * 40_000, "j at " * 40_000])
def test_detection_is_linear(text):
    pii.spans_of(text)


@pytest.fixture(scope="module")
def page_model():
    return train(labelled_pages(TRAIN_PAGES))


def test_page_model_holds_on_unseen_layouts(page_model):
    right = 0
    for html in labelled_pages(60, seed=99):
        nodes = parse(html)
        y = node_labels(nodes)
        want = "\n".join(n.text for n, v in zip(nodes, y, strict=True) if n.text is not None and v)
        right += want == main_text(html.replace("data-label", "data-x"), page_model)
    assert right >= 57


def test_page_text_rules(page_model):
    html = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
    <article><h1>A &amp; B</h1><p>One   two<br>three &lt;b&gt; <b>bold</b>word.<script>var t="</p>";</script><p>Next&nbsp;one
    <div class="comments"><p>I do not agree with this.</p></div></article><footer>&copy; me</footer>"""
    assert main_text(html, page_model) == "A & B\nOne two three <b> boldword.\nNext one"
    for broken in ("", "<", "<p", "<!-- x", "text", "</p></div>", "<a href='x", "<script>", "&amp", "<p>" * 3000, "<b " * 3000, "<!--" * 3000):
        main_text(broken, page_model)


def test_names_of_parts_may_be_unknown(page_model):
    """A layout written by hand whose names the training pages never hold."""
    text = "Ein längerer Absatz mit vielen Wörtern, der vom Weg berichtet. Und noch ein Satz dazu, der nicht kurz ist."
    html = f"""<html><body><div class="menue"><ul><li><a href="/a">Start</a></li><li><a href="/b">Themen</a></li><li><a href="/c">Kontakt</a></li></ul></div>
    <div class="inhalt"><h1>Der lange Weg nach Hause</h1><p>{text}</p><p>{text}</p><div class="werbung"><p>Jetzt kaufen!</p></div><p>{text}</p></div>
    <div class="hinweis-box"><p>Diese Seite nutzt Kekse.</p></div>
    <div class="kommentare"><div class="kommentar"><p>Schöner Text, danke.</p></div><div class="kommentar"><p>Finde ich auch.</p></div></div>
    <div class="fusszeile"><a href="/i">Impressum</a> | <a href="/d">Datenschutz</a></div></body></html>"""
    assert main_text(html, page_model) == "\n".join(["Der lange Weg nach Hause", text, text, text])


def archive(tmp_path, records):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(records))
    return str(path)


def test_archive_ranges_give_each_record_once(tmp_path):
    pages = [(i, f"http://e/{i}", f"<p>{'x' * (i * 37 % 500)}é {i}</p>".encode()) for i in range(60)] + [(60, None, b""), (61, "u\né", b"\x1f\x8b\x08" * 50)]
    path = archive(tmp_path, [warc.page_record(i, u, p, None, False) for i, u, p in pages] + [b"\0" * 10, warc.page_record(62, "v", b"abc", 3, True)])
    size = len((tmp_path / "a.warc.gz").read_bytes())
    for step in (1 << 20, 1000, 333, 97):
        got = [r for a in range(0, size, step) for r in warc.read_range(path, a, min(size, a + step))]
        assert [warc.page_of(f["WARC-Record-ID"]) for f, _ in got] == [*range(63)]
        assert [b.partition(b"\r\n\r\n")[2] for _, b in got[:-1]] == [p for _, _, p in pages]
    fields, block = got[-1]
    assert fields["WARC-Type"] == "revisit" and warc.page_of(fields["WARC-Refers-To"]) == 3 and b"Content-Length: 3\r\n" in block
    assert fields["WARC-Payload-Digest"] == "sha1:" + warc.base32_sha1(b"abc")


def test_damaged_members_are_passed_over(tmp_path):
    good = [warc.page_record(i, "u", b"p" * 50, None, False) for i in range(3)]
    path = archive(tmp_path, [good[0], warc.MAGIC + b"\0\0\0\0\0\x03junk", good[1][:40], good[2]])
    size = len((tmp_path / "a.warc.gz").read_bytes())
    assert [warc.page_of(f["WARC-Record-ID"]) for f, _ in warc.read_range(path, 0, size)] == [0, 2]


def test_words_and_runs_of_benchmarks():
    a, b = (w for _, w in word_hashes(pa.array(["The Cat, sat on: the MAT again", "the cat sat; on the mat AGAIN"])))
    assert a.tobytes() == b.tobytes()
    item = np.arange(20, dtype=np.uint64)
    doc = np.concatenate([np.full(5, 99, np.uint64), item, np.full(3, 98, np.uint64)])
    assert best_run(item, doc, 5) == (20, 20, 5)
    doc[[9, 14, 19]] = 77  # of item 4, 9 and 14: four words in five are equal, and the whole is the longest of the best runs
    assert best_run(item, doc, 5) == (20, 17, 5)
    doc[[10, 11]] = 77  # now a part is better
    assert best_run(item, doc, 5) == (10, 9, 15)
    assert best_run(item, doc[12:], -7) == (10, 9, 3)


def longest_brute(item, doc, offset):
    n, best = len(item), (0, 0, 0)
    for i in range(n):
        for j in range(i + 1, n + 1):
            if 0 <= i + offset and j + offset <= len(doc):
                same = [item[k] == doc[k + offset] for k in range(i, j)]
                if 5 * sum(same) >= 4 * len(same) and (j - i == n or same[0] and same[-1]):
                    best = max(best, (j - i, sum(same), -(i + offset)))
    return best[0], best[1], -best[2]


def test_longest_runs_match_brute_force():
    r = np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(1, 30))
        item = np.arange(n, dtype=np.uint64)
        doc = np.concatenate([np.full(4, 99, np.uint64), item, np.full(int(r.integers(0, 4)), 98, np.uint64)])
        doc[r.random(len(doc)) < r.choice([0.1, 0.25, 0.5])] = 77
        cut = int(r.integers(0, 8))
        assert longest_run(item, doc[cut:], 4 - cut) == longest_brute(item.tolist(), doc[cut:].tolist(), 4 - cut)


@pytest.mark.parametrize("n", range(1, 24))
def test_no_run_is_lost_by_the_seeds(n):
    words = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    find = seeds if n >= 12 else lambda w: short_seeds(w, (n,))
    there = set(zip(*(x.tolist() for x in find(words)), strict=True))
    every = list(combinations(range(n), n // 5))
    for bad in every if len(every) < 1000 else random.Random(n).sample(every, 1000):
        doc = words.copy()
        doc[list(bad)] = 77
        assert there & set(zip(*(x.tolist() for x in find(doc)), strict=True)), bad
        assert longest_run(words, doc, 0) == (n, n - len(bad), 0)


def test_code_points_survive_broken_utf8():
    raw = np.frombuffer("aé日".encode() + b"\xff\xc3" + "ß".encode(), np.uint8)
    cp, off = code_points(raw, np.array([0, 6, 8, 10]))
    assert off[-1] == len(cp) and cp[:3].tolist() == [97, 233, 0x65E5] and cp[-1] == 0xDF
    for _, n, bucket, row, letters in ngrams(pa.array(["", None, "12 3", "ab"])):
        assert n == 4 and letters.tolist() == [0, 0, 0, 2] and len(bucket) == len(row)


def word_model():
    text = " ".join(["the idiot was a clown and the moron is a loser", "scum and trash", "stupid idiot there"] * 50)
    grams = {}
    for batch in toxicity.count_trigrams([pa.record_batch([pa.array([text])], names=["text"])]):
        grams = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    n = np.ones(toxicity.SYMBOLS ** 3) * 0.01
    n[list(grams)] += list(grams.values())
    n = n.reshape((toxicity.SYMBOLS,) * 3)
    return toxicity.Decoder(-np.log(n / n.sum(2, keepdims=True)))


def test_decoder_restores_disguised_words():
    d = word_model()
    for token, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("cl0wn", "clown"), ("$tup!d", "stupid"), ("idiooot", "idiot"), ("looooser", "loser"), ("tr@sh", "trash")):
        assert word in d.restore(token), (token, d.restore(token))


@pytest.mark.parametrize("written", ["an 1d10t here", "an i d i o t here", "an i.d.i.o.t here", "an idiooot here", "an IDIOT here", "an 1-d-1-0-t here"])
def test_suspicious_tokens_reach_the_features(written):
    n = np.ones((toxicity.SYMBOLS,) * 3)
    for w in ["idiot"] * 200:
        s = [0, *(ord(c) - 96 for c in w), 0]
        for i in range(2, len(s)):
            n[s[i - 2], s[i - 1], s[i]] += 1
    d = toxicity.Decoder(-np.log(n / n.sum(2, keepdims=True)))
    want = set(toxicity.feature_buckets(["idiot"]).tolist())
    got = {int(f) for _, fs, _ in toxicity.features(pa.array([written]), d) for f in fs}
    assert want <= got


@pytest.mark.parametrize("n", [30, 33, 5000])
def test_tokens_of_any_length_are_restored(n):
    d = word_model()
    def restored(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        off = np.array([0, len(buf)])
        return {w for _, token in toxicity.suspicious(buf, off, *toxicity.word_spans(buf, off, toxicity.LETTER > 0)) for w in d.restore(token)}
    assert "stupid" in restored("a st" + "u" * n + "pid man")
    assert "stupid" in restored("a $t" + "u" * n + "p1d man")
    assert "idiot" in restored("an 1d" + "*" * n + "10t here")
    assert "idiot" in "".join(restored("an " + " ".join("idiot" * n) + " here"))


@pytest.mark.parametrize(("written", "words"), [
    ("you are a s t u p i d man", ["stupid"]), ("so s t u p i d i d i o t you", ["stupid", "idiot"]), ("the t r a s h a n d s c u m here", ["trash", "and", "scum"]),
    ("an i  d  i  o  t here", ["idiot"]), ("an i, d, i, o, t here", ["idiot"]), ("an i d i o t  a clown", ["idiot"]), ("trash a n d scum", ["and"]),
    ("y o u a r e a s t u p i d i d i o t a n d a l o s e r a n d a m o r o n", ["stupid", "idiot", "loser", "moron"]), ("a $ t u u u u p 1 d man", ["stupid"])])
def test_spaced_letters_are_split_into_words(written, words):
    want = [set(toxicity.feature_buckets([w]).tolist()) for w in words]
    got = {int(f) for _, fs, _ in toxicity.features(pa.array([written]), word_model()) for f in fs}
    assert all(w <= got for w in want)


def test_near_words_match_all_readings():
    cost = word_model().cost
    for s in ("astupid", "idiotand", "amoron", "abc"):
        found = []
        for cut in range(1 << (len(s) - 1)):
            words = "".join(ch + (" " if cut >> i & 1 else "") for i, ch in enumerate(s)).split()
            symbols = [0, 0, *(0 if ch == " " else ord(ch) - 96 for ch in " ".join(words)), 0]
            found.append((sum(cost[tuple(symbols[i - 2:i + 1])] for i in range(2, len(symbols))), words))
        least = min(found)[0]
        want = {w for c, words in found if c <= least + toxicity.MARGIN for w in words if len(w) > 2}
        assert set(toxicity.near_words([ord(ch) - 96 for ch in s], cost)) == want


def test_chi_square_and_leaves():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 0.01
    p = np.vstack([np.random.default_rng(0).normal(size=(500, 4)), np.ones((300, 4))])
    leaves = kd_leaves(p)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(800))
    assert sum(500 in r for r in leaves) == 1 and {*range(500, 800)} <= set(next(r for r in leaves if 500 in r).tolist())


def test_digest_of_spans():
    base, _ = pii.spans_of("a@b.co +1 (555) 123-4567")
    assert hashlib.sha256(pii.written(base).encode()).hexdigest() == hashlib.sha256(b"email:0:6,phone:7:24").hexdigest()


def test_marginals_equal_enumeration(page_model):
    """Sum-product on small trees against the sum over all labellings."""
    from itertools import product
    from math import exp, log

    from quadsync.llm import html_main as hm

    for html in ("<div class=content><p>Some words here.</p><ul><li><a href=x>Home</a></ul></div>", "<p>a<p>b c d", "<article><h1>T</h1><p>One two three four.</p></article><footer>x</footer>", "text"):
        nodes = hm.parse(html)
        assert len(nodes) <= 12
        f = [hm.features(nodes, i) if i else [] for i in range(len(nodes))]
        q = [1 / (1 + exp(-page_model.child[""] - sum(page_model.child.get(k, 0.0) for k in x))) for x in f]
        says = [hm.EVIDENCE * (page_model.parent[""] + sum(page_model.parent.get(k, 0.0) for k in x)) for x in f]
        total, one = 0.0, [0.0] * len(nodes)
        for y in product((0, 1), repeat=len(nodes)):
            weight = hm.ROOT * y[0]
            for i in range(1, len(nodes)):
                p = nodes[i].parent
                on = q[i] if y[p] else hm.LEAK
                weight += log(on if y[i] else 1 - on) + says[i] * y[p]
            total += exp(weight)
            one = [a + exp(weight) * v for a, v in zip(one, y, strict=True)]
        assert np.allclose(page_model.marginals(nodes), [a / total for a in one], atol=1e-9)


def test_broken_pages_cost_in_proportion():
    from time import perf_counter

    from quadsync.llm.html_tree import parse

    n = 100_000
    shapes = ["<a " * n, "<h1>x" * n, "<div>" * n + "</p>x" * n, '<a "' * n, "<div " + "a" * 10 * n + ">", "<p>" * n, '<a ">" ' * n + "'", "</script " * n, "<script>" + "</script " * n,
              "<td><label><h1>" * (n // 3), "<li>" * n, "<!-- " * n, "<" * n, "<a '" * n + ">", "<div a=" * n]
    for html in shapes:
        start = perf_counter()
        parse(html)
        assert perf_counter() - start < 10, html[:20]  # a second or two here; hours if a tag were looked at once per tag


def test_decoder_equals_all_paths_of_a_lattice():
    from itertools import product

    r = np.random.default_rng(6)
    cost = r.random((toxicity.SYMBOLS,) * 3)

    def worth(symbols, channel):
        full = [0, 0, *symbols, 0]
        return channel + sum(cost[full[i], full[i + 1], full[i + 2]] for i in range(len(full) - 2))

    for token in ("a", "5h1t", "aab", "l33t", "st$$p", "b" + toxicity.GAP + "a" + toxicity.GAP + "d", "!!"):
        places = toxicity.lattice(token)
        paths = [([s for s, _ in p if s >= 0], sum(c for _, c in p)) for p in product(*places)]
        best = min(worth(s, c) for s, c in paths)
        got = toxicity.decode(places, cost)
        assert min(worth(s, c) for s, c in paths if s == got) == pytest.approx(best), token
