"""Main text of pages, source divergence and hard negatives: brute force, planted shapes, nulls, ties, repeats, empty tables, clashing columns."""

import html as htmllib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, diff
from pyspark.sql import functions as F

from flowlantern.llm import divergence, graph_ann, html_extract, queries, strassen, surrogates, token_store

SF = "/root/testdata/sf0.01"
P = "The quick brown fox jumps over the lazy dog and then goes on to write a much longer sentence about it all."


# ---- op11 -----------------------------------------------------------------------------------------
def test_pages_of_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op11_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S).group(1)
        want = " ".join(htmllib.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\n", body))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize("page,want", [
    (f"<body><div class=menu><ul><li><a>x</a><li><a>y</a></ul></div><div class=content><h1>Title</h1><p>{P}<p>Short.<p>A &amp; b</div>"
     f"<div class=sidebar><p>{P}</p></div><div id=footer>c {P}</div></body>", f"Title {P} Short. A & b"),
    (f"<body><h1>Title</h1><p>{P}</p><p>Short.</p><div class='ad'>{P}</div><p>{P}</p><p>The end.</p></body>", f"Title {P} Short. {P} The end."),
    (f"<main><article><header><h1>Title</h1><p>By me</p></header><p>{P}</p><aside>{P}</aside><form><label>{P}</label></form></article>"
     f"<section id=comments><article class=comment><p>{P}{P}{P}</p></article></section></main>", f"Title {P}"),
    (f"<form id=page><div class=nav><a>h</a></div><div class=article-body><p>{P}<p>{P}</div></form>", f"{P} {P}"),
    (f"<div class=cookie-banner><p>{P}</p><button>Accept</button></div><div class='wrap with-sidebar'><div class=main-content><h2>T</h2><p>{P}</p>"
     f"<ul><li>one item<li>two</ul><table><tr><td>a<td>b</table></div><aside>{P}</aside></div>", f"T {P} one item two a b"),
    (f"<table><tr><td><a>one</a><br><a>two</a></td><td><p>{P}</p><p>{P}</p></td></tr></table><p><a>Contact</a></p>", f"{P} {P}"),
    (f"<nav><a>x</a><article><h1>T</h1><p>{P}</p></article><footer>f</footer>", f"T {P}"),
    (f"<div class=ad>buy<article><h1>T</h1><p>{P}</p></article><footer>f</footer>", f"T {P}"),
    (f"<![foo[ x ]]><p>{P}</p><script>var a='<p>'</script><style>p{{}}</style><!-- c -->", P),
    (f"<article><p>{P}</p><div class=comments><p>{P}</p></div><div class=related-posts>{P}</div><p hidden>h</p></article>", P),
    (f"<body class='nav-open sidebar'><div id=page><div id=sidebar-wrap><p>{P}</p></div><div id=post-1><p>{P}</p><p>B.</p></div></div>", f"{P} B."),
    ("<article><p>a<b>b</b>c<br>d &lt;e&gt;  f\n g</p></article>", "abc d <e> f g"),
    ("plain &amp; simple", "plain & simple"), ("", ""), ("  \n", ""), ("<nav><a>x</a></nav>", ""), ("a < b <", "a < b <"),
])
def test_planted_pages(page, want):
    assert html_extract.main_text(page) == want


def test_pages_null_long_clashing(spark):
    long = "<article>" + f"<p>{P}</p>" * 20_000 + "</article>"
    rows = spark.createDataFrame([(1, None, "t", 5), (2, "", None, None), (3, long, "t", 1), (3, long, "t", 1)], "page_id long, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["n_chars"]) for r in html_extract.extracted(rows).collect())
    assert got == [(1, 0), (2, 0), (3, 20_000 * (len(P) + 1) - 1), (3, 20_000 * (len(P) + 1) - 1)]
    assert html_extract.extracted(rows.limit(0)).count() == 0


def test_threshold_and_smoothing():
    assert html_extract.threshold(np.array([3.0, 3.1, 2.9])) == -1.0
    assert 1 < html_extract.threshold(np.array([0.5, 0.6, 4.0, 4.2])) < 4
    assert np.allclose(html_extract.smoothed(np.ones(7)), 1)


# ---- op12 -----------------------------------------------------------------------------------------
def _divergence(rows, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    df, count, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(lower))
        count[lang, source].update(words)
        total[lang].update(words)
        df[lang].update(set(words))
    out = []
    for (lang, source), c in count.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = share(c), share(total[lang])
        pairs = []
        for (l2, s2), c2 in count.items():
            if l2 == lang and s2 != source:
                o = share(c2)
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), s2.encode()))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if c[t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "abé" for b in "xyzÉ漢" for c in "KLM"] + ["", "9", "a1b", "ÀB"]
    rows = [(" ".join(rng.choice(words, int(n))) if n else None, str(rng.choice(["en", "de"])), f"s{int(rng.integers(0, 9))}") for n in rng.integers(0, 40, 120)]
    rows += [(None, None, None), ("", "xx", "only"), ("abc", None, ""), ("Abc ABC", "en", None), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    monkeypatch.setattr(divergence, "GROUPS", 3)  # several blocks on each axis of the cube
    monkeypatch.setattr(divergence, "TERMS", 7)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(tuple(r[c] for c in cols) for r in divergence.audited(docs, top=10).collect())
    assert got == _divergence(rows, top=10)
    assert divergence.audited(docs.limit(0)).count() == 0


def test_share_is_exact_for_large_counts(spark):
    rows = [(0, 1), (5, 6), (10**12, 10**13 + 7), (8 * 10**15, 8 * 10**15 + 1), (3, 10**15)]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (r["c"] + 1) // r["t"] for r in got]


# ---- op13 -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("n,k,m", [(1, 1, 1), (65, 70, 67), (129, 131, 200), (300, 64, 90), (257, 129, 255)])
def test_strassen(n, k, m):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-1000, 1000, (n, k)), rng.integers(-1000, 1000, (k, m))
    assert (strassen.multiply(a, b) == a @ b).all()
    big = a.astype(object) * 10**12
    assert (strassen.multiply(big, b.astype(object)) == big @ b.astype(object)).all()


def _mined(rows, anchor):
    rows = {i: (label, v) for i, label, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in rows.items():
        if not anchor(a):
            continue
        scored = [(-dot(v, w), i, other) for i, (other, w) in rows.items() if i != a]
        for ps, p in sorted((s, i) for s, i, other in scored if other == label)[:5]:
            near = sorted((s, i) for s, i, other in scored if other != label and -80 * ps <= -100 * s <= -100 * ps)[:5]
            out += [(a, p, k, i, -ps, -s) for k, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_hard_negatives_brute_force(spark, monkeypatch):
    monkeypatch.setattr(strassen, "BLOCK_BYTES", 8 * 12 * 40)  # several blocks and tiles
    monkeypatch.setattr(strassen, "TILE", 16)
    monkeypatch.setattr(strassen, "LEAF", 4)
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 4)), np.round(rng.normal(size=12) * (1 if i % 9 else 1e6), 1).tolist()) for i in range(400)]
    rows += [(i, 1, rows[3][2]) for i in range(400, 420)] + [(420, 2, [0.0] * 12), (421, 2, rows[5][2][:5]), (440, 2, [])]
    bad = [(500, None, [1.0] * 12), (520, 1, None), (540, 1, [1.0, None]), (560, 1, [float("nan")]), (580, 1, [float("inf"), 1.0]), (None, 1, [1.0] * 12)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows + bad + rows[:30]], "vec_id long, label int, embedding array<double>, share string, block int")
    got = strassen.mined(strassen.valid_rows(table.repartition(3)), F.col("vec_id") % 20 == 0).collect()
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _mined([(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows], lambda i: i % 20 == 0)
    assert sorted(tuple(r[c] for c in cols) for r in got) == want and want
    assert strassen.mined(strassen.valid_rows(table.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_hard_negatives"])
def test_sql(spark, name):
    _, err = diff(queries.QUERIES[name](spark, SF), queries.ORACLES[name], connect(SF))
    assert err is None


# ---- op3, op4 -------------------------------------------------------------------------------------
@pytest.mark.parametrize("limit", [10])
def test_surrogates_of_full_shapes(spark, monkeypatch, limit):
    """All values of a shape in use: the draws end, distinct entities stay distinct, mentions stay together. Both ways to pass exceptions on."""
    monkeypatch.setattr(surrogates, "EXCEPTIONS", limit)
    mails = [f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    hosts = [f"192.168.{i}.{j}" for i in range(256) for j in range(256)]
    texts = ["mail " + " and ".join(mails[k:k + 50]) for k in range(0, len(mails), 50)]
    texts += ["from " + " to ".join(hosts[k:k + 2000]) for k in range(0, len(hosts), 2000)] + ["again a@a.com", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in surrogates.replaced(docs, b"k").collect()}
    new = [e[3] for i in sorted(got) for e in surrogates.entities(got[i]["text"] or "")]
    assert len(new) == len(mails) + len(hosts) + 1 and len(set(new)) == len(mails) + len(hosts)
    assert got[len(texts) - 3]["text"] == "again " + new[0]
    assert not set(new) & set(mails)
    assert all(h.startswith("192.168.") for h in new[len(mails):-1])


def test_surrogates_keep_script_and_validity():
    for name in ("محمد علي", "王小明", "देव"):
        for attempt in (0, 9):
            out = surrogates.surrogate(b"k", "man", name, attempt)
            assert out != name and all(surrogates._range(c) == surrogates._range(name[0]) or c == " " for c in out)
    for attempt in (0, surrogates.DRAWS):
        assert surrogates._is_iban(surrogates.surrogate(b"k", "iban", "de89370400440532013000", attempt))
        card = surrogates.surrogate(b"k", "card", "4111111111111111", attempt)
        assert card != "4111111111111111" and surrogates._luhn(card[:-1]) == int(card[-1])


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000])
def test_index_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-2**62, 2**62, n))
    seeds, slots = token_store.build_index(keys)
    assert sorted(slots) == list(range(n)) and (token_store.slot_of(keys, seeds, n) == slots).all()


# ---- op6 -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("size", [1e25, 1e-25, 1e-170])
def test_vectors_of_any_size_in_many_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(graph_ann, "SHARD", 150)
    monkeypatch.setattr(graph_ann, "BLOCK", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 8)) * size
    x[7] = x[3]
    x[9] = x[3] * 1e-140
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] + [1.0] * 7), (None, [1.0] * 8)]
    got = graph_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in range(0, 400, 20):
        unit = x / size
        d = np.sqrt(((unit - unit[q]) ** 2).sum(1)) * size
        want = [i for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        hits += len(set(want) & {r["vec_id"] for r in mine})
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], rel=1e-12, abs=0) for r in mine)
    assert hits >= 0.9 * 200


def test_search_of_repeated_ids_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>, score double, v string, shard int"
    rows = [(0, [1.0, 0.0], 1.0, "x", 1), (0, [9.0, 0.0], None, None, None), (1, [2.0, 0.0], 1.0, "x", 1), (2, [9.0, 0.0], 1.0, "x", 1), (3, [1.0], 0.0, "y", 2)]
    got = graph_ann.search(spark.createDataFrame(rows, schema), F.col("vec_id") < 2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 8.0), (1, 1, 0, 1.0), (1, 2, 2, 7.0)]
    assert graph_ann.search(spark.createDataFrame([], schema), F.col("vec_id") < 2).collect() == []
