"""Main text, language, quality, decontamination, near-duplicates, personal data, pipeline."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from gritmeter.llm import decontam, html, language, minhash, pii, quality

from .conftest import ODD

DATA = "/root/testdata/sf0.001"


# -- main text


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""), ("plain", "plain"), ("<p>a<p>b<ul><li>x<li>y</ul>c &amp; d&nbsp;e <3 f", "a b x y c & d e <3 f"),
        ("<div class=sidebar>no</div><div>yes <b>b</b>old</div><script>if(a<b){'</p>'}</script>", "yes bold"),
        ("<header>site</header><main><header><h1>T</h1></header>body<form>f</form></main><footer>z</footer>", "T body"),
        ("<article>A<div class='comments'>c</div></article><article class=comment>C</article>", "A"),
        ("<!-- x <p>y</p>", ""), ("<a title='x>y'>q</a> <p hidden>h</p>", "q"), ("<p>un<b>closed", "unclosed"), ("<nav><p>n</nav>x</p>y", "x y"),
    ],
)
def test_page_text(source, text):
    assert html.Page(source).text() == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/apdiv=\"' -!x&;", max_size=80))
def test_any_markup_is_survived(source):
    page = html.Page(source)
    codes, shapes, _, _ = page.found()
    page.text({*codes, *shapes})


def test_templates_are_removed_per_host(spark):
    box = "<div>Welcome to the shop of all things</div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<p>unique text {i}</p><p>all rights reserved</p></body>") for i in range(8)]
    rows += [(100, "http://b.example/", f"<body>{box}<p>only here</p></body>"), (101, None, f"{box}x"), (102, "http://a.example/n", None), (103, "http://a.example/0", rows[0][2])]
    rows += [(200 + i, f"http://m.example/{i}", "<p>the same mirrored article</p>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.main_text(pages).collect()}
    assert got[3][0] == "unique text 3" and got[100][0] == "Welcome to the shop of all things only here"
    assert got[101][0].endswith("x") and got[102] == ("", 0) and got[103] == got[0] and got[205][0] == "the same mirrored article"
    assert html.main_text(pages.where("false")).count() == 0


def _site(n, words=lambda i, k: f"word{i}x{k}"):
    """Pages of one site in plain divisions: a menu, an advert, an article and a footer, each with words of its own."""
    pages = []
    for i in range(n):
        menu = "".join(f"<li><a href=/{k}>{words(i, k)}</a></li>" for k in range(3 + i % 4))
        body = "".join(f"<p>{' '.join(words(i, f'p{k}w{j}') for j in range(25))}</p>" for k in range(2 + i % 5))
        pages.append((i, f"http://plain.example/{i}", f"<html><body><div><ul>{menu}</ul></div><div>Buy {words(i, 'ad')} now</div><div><h1>{words(i, 'title')}</h1>{body}</div><div>&copy; {words(i, 'foot')}</div></body></html>"))
    return pages


def test_templates_of_changing_words_are_found_by_shape(spark):
    pages = _site(12)
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, source in pages:
        assert got[i] == " ".join(re.sub("<[^>]*>", " ", re.search("<h1>.*</p>", source).group()).split())


def test_templates_against_a_plain_count(spark):
    """Per host, every block that stands word for word on enough different pages, by a tree walk of the pages' own making."""
    rng, rows = random.Random(4), []
    blocks = [f"<div><b>box {k}</b> of the house</div>" for k in range(6)]
    chosen = {}
    for i in range(60):
        host, own = f"h{i % 3}.example", [b for b in blocks if rng.random() < 0.35]
        chosen[i] = host, own
        rows.append((i, f"https://{host}/{i}", "<body>" + "".join(own) + f"<section><p>page {i} tells {' '.join(str(i * k) for k in range(40))}</p></section></body>"))
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (host, own) in chosen.items():
        pages = [o for h, o in chosen.values() if h == host]
        kept = [b for b in own if (n := sum(b in o for o in pages)) < html.LEAST_PAGES or n < html.LEAST_SHARE * len(pages)]
        if not kept:  # a box of words that stay on few pages only may still go by its shape
            assert got[i].startswith(f"page {i} tells")
        assert got[i].endswith(f"page {i} tells {' '.join(str(i * k) for k in range(40))}")


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "x", "<li>" + "<ul>" + "<div>" * 30_000 + "<li>a</li>" * 30_000, "<nav>" * 100_000, "<article><p>a" * 50_000])
def test_deep_pages_take_linear_time(source):
    import time

    start = time.time()
    page = html.Page(source)
    page.text(set(page.found()[0]))
    assert time.time() - start < 30


# -- language


def _speech(k, n, rng):
    words = {"en": "the of and to in that is was for with".split(), "de": "der die und das nicht ist mit auch für eine".split(), "fr": "le la les des est une dans pour que qui".split()}
    return " ".join(rng.choice(words[k]) for _ in range(n))


def test_language_accuracy_and_edges(make):
    rng = random.Random(3)
    rows = [(i, _speech(("en", "de", "fr")[i % 3], 30, rng), ("en", "de", "fr")[i % 3]) for i in range(300)] + [(1000, None), (1001, "12 345 !"), (1002, "日本語"), (1003, "the and of", None)]
    got = {r["doc_id"]: r for r in language.identify(make(rows)).collect()}
    assert all(got[i]["lang_pred"] == ("en", "de", "fr")[i % 3] and 0 < got[i]["score"] <= 1 for i in range(300))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] in ("en", "de", "fr") and got[1003]["lang_pred"] == "en"


def test_language_against_plain_out_of_place():
    rng = random.Random(5)
    profiles = {}
    for k in ("en", "de"):
        g, n = language.np.unique(language._grams(language._stream(_speech(k, 400, rng))), return_counts=True)
        profiles[k] = [x for _, x in sorted(zip((-n).tolist(), g.tolist(), strict=True))][:400]
    ranker = language.Ranker(profiles)
    for text in ("the cat and der Hund", "nicht mit mir", "was für eine", "zzz qqq xxx the", "日本語 with"):
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        count = {}
        for w in (f" {w} " for w in words):
            for n in (1, 2, 3):
                for k in range(len(w) - n + 1):
                    if w[k : k + n].strip():
                        count[w[k : k + n]] = count.get(w[k : k + n], 0) + 1
        pack = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
        own = sorted((pack(g) for g in count), key=lambda p: (-{pack(g): n for g, n in count.items()}[p], p))[:300]
        assert language.document_grams(text).tolist() == own
        far = {k: sum(abs(i - p.index(g)) if g in p else 400 for i, g in enumerate(own)) for k, p in profiles.items()}
        assert ranker.predict(text)[0] == min(far, key=lambda k: (far[k], k))


def test_grams_of_parts_are_those_of_the_whole(monkeypatch):
    text = " ".join(_speech(k, 200, random.Random(8)) for k in ("en", "de", "fr"))
    whole = language.document_grams(text).tolist()
    for part in (7, 50, 1000):
        monkeypatch.setattr(language, "_PART", part)
        assert language.document_grams(text).tolist() == whole


def test_language_empty(none, make):
    assert language.identify(none).count() == 0
    assert {r["lang_pred"] for r in language.identify(make([(1, "words", None)])).collect()} == {"und"}


# -- quality


def test_quality_learns_and_scores_all(spark, make):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta house tree river".split()) + rng.choice(["", "", ","]) for _ in range(150))
    bad = lambda: " ".join(["SPAM!!"] * 150)
    rows = [(i, good() if i % 3 else bad()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (9999, 0, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(make(rows), labels).collect()}
    out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in out) for i in range(300))
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in out) and all(0 <= r["score"] <= 1 for r in got.values())
    kept = quality.keep_good(make(rows), labels)
    assert kept.columns == make(rows).columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(300) if got[i]["predicted"]}


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(odd, labels).collect()} == {1.0}
    assert {r["score"] for r in quality.quality(odd, labels.where("false")).collect()} == {0.5}
    assert quality.quality(none, labels).count() == 0


def test_attention_gradient():
    np = quality.np
    r = np.random.Generator(np.random.PCG64(0))
    x, first, y, net = r.normal(size=(7, quality.FEATURES)), np.array([0, 3, 7]), np.array([1.0, 0.0]), quality.Network()
    loss = lambda: -np.mean(y * np.log(net.forward(x, first)["y"]) + (1 - y) * np.log(1 - net.forward(x, first)["y"]))
    grad = net.gradient(net.forward(x, first), y)
    for k in net.p:
        at = (0,) * net.p[k].ndim
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        assert grad[k][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
        net.p[k][at] += 1e-5


def test_scores_against_a_plain_forward_pass():
    import math

    net = quality.Network(3)
    rng = np.random.Generator(np.random.PCG64(1))
    net.odds = rng.normal(size=net.odds.shape)
    texts = [b"", b"one two three", b"Some Words! " * 70, "é 12 <tag> x".encode() * 200]
    x, first, bag, lex = quality.passages(texts, net.odds)
    for i in range(len(x)):
        own = np.flatnonzero(bag == i)
        if len(own):
            assert x[i, -2:] == pytest.approx([np.mean([net.odds[k][lex[k][j]] for j in own]) for k in (0, 1)])
    got = net.score(texts)
    for i, (a, b) in enumerate(zip(first, first[1:])):
        hidden, energy = [], []
        for row in x[a:b]:
            h = [math.tanh(sum(row[f] * net.p["w"][f][j] for f in range(len(row)) if abs(row[f]) <= 8) + sum(math.copysign(8, row[f]) * net.p["w"][f][j] for f in range(len(row)) if abs(row[f]) > 8) + net.p["wb"][j]) for j in range(quality.EMBED)]
            t = [math.tanh(sum(h[j] * net.p["v"][j][g] for j in range(quality.EMBED)) + net.p["vb"][g]) for g in range(quality.GATE)]
            s = [1 / (1 + math.exp(-sum(h[j] * net.p["u"][j][g] for j in range(quality.EMBED)) - net.p["ub"][g])) for g in range(quality.GATE)]
            hidden.append(h)
            energy.append(sum(t[g] * s[g] * net.p["a"][g] for g in range(quality.GATE)))
        weight = [math.exp(e) for e in energy]
        z = [sum(w * h[j] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(quality.EMBED)]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(z[j] * net.p["c"][j] for j in range(quality.EMBED)) - net.p["cb"][0])))


def test_log_odds_of_buckets():
    counts = np.zeros((2, 2, quality.BUCKETS))
    counts[1, 0, 7], counts[0, 0, 8] = 10_000, 10_000
    odds = quality.lexicon(counts)
    assert odds[0, 7] == quality.ODDS and odds[0, 8] == -quality.ODDS and abs(odds[1]).max() == 0


# -- decontamination


def _brute_contamination(docs, items, size=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for i, text in docs:
        w, hit, ids = split(text), set(), set()
        for item, t in items:
            v = split(t)
            n = min(size, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[k : k + n]:
                        hit |= set(range(at, at + n))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_against_brute_force(spark, make):
    rng = random.Random(7)
    word = lambda: rng.choice("a b c d É x1".split())
    items = [(1, " ".join(word() for _ in range(14))), (2, "Lone"), (3, "two Words"), (4, None), (5, ""), (6, "!!"), (10, "a b c d e f g"), (10, "a b c d e f g")]
    docs = [(i, "; ".join(word().upper() for _ in range(rng.randrange(60)))) for i in range(25)] + [(30, f"pre {items[0][1]} post lone"), (31, items[0][1]), (32, "two words a b c d e f g"), (32, "two words"), (33, None), (34, ""), (None, "lone wolf"), (35, "É" + items[0][1])]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, gram string, n int")
    got = sorted((tuple(r) for r in decontam.contamination(make(docs), bench).collect()), key=str)
    assert got == _brute_contamination(docs, items)
    assert {r["contaminated"] for r in decontam.contamination(make(docs), bench.where("false")).collect()} == {False}
    # A shuffled input has another row order each time it is computed.
    mixed = sorted((tuple(r) for r in decontam.contamination(make(docs * 3).repartition(7), bench).collect()), key=str)
    assert mixed == sorted(got * 3, key=str)


def test_contamination_empty(spark, none):
    assert decontam.contamination(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# -- near-duplicates


def _brute_groups(docs):
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = {i: i for i in sets}
    find = lambda x: x if group[x] == x else find(group[x])
    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= 70 * len(x | y) for x in sets[a] for y in sets[b]):
                group[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def test_near_duplicates_against_brute_force(make):
    rng = random.Random(11)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice([4, 8, 40, 90]))] for _ in range(8)]
    docs = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randrange(9))
        docs.append((i, rng.choice([" ", "\n", "  "]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, " \t"), (503, "hi"), (504, "HI "), (505, "hi there"), (3, "hi there")]
    got = minhash.near_duplicates(make(docs)).collect()
    want = _brute_groups(docs)
    assert len(got) == len(docs) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(odd, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and sum(r["doc_id"] is None and r["component_id"] is None for r in got) == 1
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert minhash.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(200, 100), (100, 300)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    assert all(got[i] == 1 for i in range(2, 61)) and got[200] == got[300] == 100


def test_dense_regions_are_cut_deeper(make, monkeypatch):
    monkeypatch.setattr(minhash, "REGION_ROWS", 3)
    monkeypatch.setattr(minhash, "REGION_SAMPLE", 1)
    docs = [(i, " ".join(f"w{k}" for k in range(60)) + f" end{i}") for i in range(12)]
    assert {r["component_id"] for r in minhash.near_duplicates(make(docs)).collect()} == {0}


def test_long_classes_of_one_region_are_ordered_by_their_minima(spark):
    rng, half = np.random.default_rng(5), 25
    sig = rng.integers(0, 2**20, (2 * half, minhash.HASHES)).astype(np.uint32)  # as of sets of some thousand shingles
    sig[:, : minhash.DEPTH] = 7
    sig[half:, minhash.DEPTH : minhash.DEPTH + 2] = sig[:half, minhash.DEPTH : minhash.DEPTH + 2]
    classes = spark.createDataFrame([(i, 4000, bytearray(x.tobytes())) for i, x in enumerate(sig)], "node long, n long, sig binary")
    assert {(i, i + half) for i in range(half)} <= {(r["a"], r["b"]) for r in minhash.candidates(classes)[0].collect()}


def _family(n, words=100):
    """Texts of ``words`` words of which each has 4 to 12 of a hundred replaced, in a run of its own: many pairs stand near 0.7."""
    rng, docs = random.Random(3), []
    for i in range(n):
        w = [f"w{k}" for k in range(words)]
        for k in range(start := rng.randrange(words * 3 // 5), start + rng.randrange(words // 25, words // 8 + 1)):
            w[k] = f"x{i}y{k}"
        docs.append((i * 7 % 1009, " ".join(w + [f"z{rng.randrange(3)}"] * 5)))
    return docs


@pytest.mark.parametrize("sample", [1, 16])
def test_links_that_the_forest_misses_are_found(make, monkeypatch, sample):
    monkeypatch.setattr(minhash, "SAMPLE", sample)
    none = lambda classes: classes.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    monkeypatch.setattr(minhash, "candidates", lambda classes: (none(classes), classes.select(F.lit(0).alias("tree"), F.lit(0).alias("base"), "node")))
    docs = _family(60) + [(2000 + i, " ".join(f"v{i // 2}u{k + i % 2 * 3}" for k in range(30))) for i in range(40)] + [(3000, "short one"), (3001, "Short one"), (3002, None)]
    want = _brute_groups(docs)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(docs)).collect()} == want
    assert len(set(want.values())) > 3


@pytest.mark.parametrize("neighbours", [1, 12])
def test_long_texts_in_a_dense_region(make, monkeypatch, neighbours):
    monkeypatch.setattr(minhash, "NEIGHBOURS", neighbours)
    docs = _family(70, 1000)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(make(docs)).collect()} == _brute_groups(docs)


# -- personal data

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@-+0125 ()%é\n", max_size=50))
def test_base_spans_against_plain_rules(text):
    assert pii.base_spans(text) == _brute_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["x@y.zz", "a@b@c.de", "1.2.3.4", "1.2.3.400", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0100", "+12", "..", " ", "1", "é", "@", "@@a.b"]), max_size=9))
def test_base_spans_of_joined_parts(parts):
    assert pii.base_spans("".join(parts)) == _brute_spans("".join(parts))


def test_personal_data_rows(make, none):
    rows = [(1, "write to bob@mail.example.com or +1 (555) 555-0100"), (2, None), (3, ""), (4, "key password=9f8e7d6c5b4a39281706 end"), (4, "key password=9f8e7d6c5b4a39281706 end"), (None, "é 10.0.0.1"), (5, "nothing here")]
    rows += [(100 + i, f"token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\"") for i in range(40)]
    got = {}
    for r in pii.personal_data(make(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[1][0]["spans"] == "email:9:29,phone:33:50" and got[1][0]["base_sha256"] == hashlib.sha256(b"email:9:29,phone:33:50").hexdigest()
    assert got[2][0]["spans"] == got[3][0]["spans"] == got[5][0]["spans"] == "" and len(got[4]) == 2 and got[4][0]["spans"] == "secret:13:33"
    assert got[None][0]["spans"] == "ip:2:10" and got[100][0]["spans"].startswith("secret:")
    assert pii.personal_data(none).count() == 0


def test_spans_that_start_together_go_by_name(make):
    rows = {1: ("4111111111111111@x.yy", "card:0:16,email:0:21"), 2: ("000000000000.0.0.0", "card:0:12,ip:0:18"), 3: ("+4915112345679@1.2.3.4", "email:0:22,phone:0:14,ip:15:22"), 4: ("é 1.2.3.4@x.yy", "email:2:14,ip:2:9")}
    got = {r["doc_id"]: (r["spans"], r["base_sha256"]) for r in pii.personal_data(make([(k, t) for k, (t, _) in rows.items()])).collect()}
    assert got == {k: (s, hashlib.sha256(s.encode()).hexdigest()) for k, (_, s) in rows.items()}


def test_masking(make):
    docs = make([(1, "write to bob@mail.example.com now"), (2, None), (3, "clean")])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask(docs).collect()}
    assert got == {1: ("write to <EMAIL> now", 20), 2: (None, None), 3: ("clean", 5)} and pii.mask(docs).columns == docs.columns


def test_em_finds_the_bad_labeler():
    rng, counts = random.Random(2), {}
    for _ in range(4000):
        truth = rng.random() < 0.5
        votes = "".join(("+" if truth == (rng.random() < p) else "-") for p in (0.95, 0.9, 0.9, 0.6, 0.9)) + "00"
        counts[votes] = counts.get(votes, 0) + 1
    _, right = pii.em([(4, v, n) for v, n in sorted(counts.items())])
    assert right.argmin() == 3 and right[0] > 0.9


# -- pipeline


def test_pipeline_against_the_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r["lossless"] for r in corpus_pipeline.run(spark, DATA).collect()}
    c = duckdb.connect()
    c.sql(f"create view labels as select * from read_parquet('{DATA}/labels.parquet')")
    good = {r["doc_id"] for r in quality.quality(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = _brute_groups([(i, texts[i]) for i in sorted(good)])
    first = [i for i in sorted(good) if groups[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r[0] for r in _brute_contamination([(i, texts[i]) for i in first], items) if not r[5]}
    assert set(got) == clean and all(got.values())


def test_rows_of_null_or_repeated_ids_are_judged_by_their_own_text(spark, make, tmp_path):
    folder = f"file://{tmp_path}"
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(None, "one clean text of its own here"), (None, f"with {item} inside"), (None, "another clean text that differs much"), (4, "shared words stand in this text twice"), (4, f"{item} again"), (5, "shared words stand in this text twice")]
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = corpus_pipeline.uncontaminated(spark, corpus_pipeline.distinct(spark, docs, folder), folder)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(None, rows[0][1]), (None, rows[2][1]), (5, rows[5][1])], key=str)


def test_stages_keep_columns_and_survive_odd_rows(spark, make, tmp_path):
    folder = f"file://{tmp_path}"
    make(ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
    ids = sorted((r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, None, 7, 8, 9], key=str)
    spark.createDataFrame([], docs.schema).write.parquet(f"{folder}/none/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").write.parquet(f"{folder}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
