"""Main text of pages, codes of vectors and spelling variants, against planted pages and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkbasin.llm import op11_html, op12_codes, op13_variants

# --- 11 ---

P1 = "The river rose for three days before anyone in the town thought of moving the boats to higher ground."
P2 = "Nobody was hurt, but the bridge by the mill has been closed until the engineers have looked at every pier."
SHORT = "It was late."
#: (html, main text)
PAGES = {
    "article": (f"<!DOCTYPE html><html><head><title>t &am</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav><!-- ad --><div class='ad'>Buy our new boots now. They are on sale.</div><article><h1>Flood &amp; after</h1><p><b>{P1}<br><p>{SHORT}</p><p>{P2}</p></article><footer>&copy; 2024 The Paper</footer>", f"Flood & after\n\n{P1}\n\n{SHORT}\n\n{P2}"),
    "names": (f"<body><div id='siteHeader'>The Paper</div><div class='main-menu'><a href=/>Home</a> <a href=/x>News</a></div><div class='post-content'><h2>Flood</h2><p>{P1}</p><div class='share'>Share this on</div><p>{P2}</p></div><div class='sidebar'><p>{P2} {P2}</p></div><div id='comments'><p>{P1} I was there.</p></div><div class='footer'>All rights</div></body>", f"Flood\n\n{P1}\n\n{P2}"),
    "parts": (f"<body><header><h1>The Paper</h1></header><main><article><header><h1>Flood</h1></header><p>{P1}</p><aside>{P2}</aside><p>{P2}</p><section><h3>3 Comments</h3><p>{P1} So it was.</p></section></article></main><form action=/s><label>Mail</label><p>{P1} Sign here.</p><input name=q></form></body>", f"Flood\n\n{P1}\n\n{P2}"),
    "bare": (f"<div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div><p>{P1} {P2}</p><p>{P2} {P1}</p></div><div><a href=/i>Imprint</a> <a href=/t>Terms of use</a></div>", f"{P1} {P2}\n\n{P2} {P1}"),
    "spaces": (f"<main><p>  {P1}\n\t<i>Then</i>&nbsp;<b>it</b>\r\nrained&lt;p&gt;.  </p></main>", f"{P1} Then it rained<p>."),
    "unclosed": (f"<article><p>{P1}<p>{P2}<script>var x = 1", f"{P1}\n\n{P2}"),
    "quotes": (f'<article><p title="a > b">{P1}</p><p title="x>{P2}</p></article>', f"{P1}\n\n{P2}"),
    "nothing": ("<nav><a href=/>Home</a></nav><footer>&copy; x</footer>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


def test_main_text(spark):
    rows = [(i, f"http://x/{name}", page, 1) for i, (name, (page, _)) in enumerate(PAGES.items())]
    rows += [(0, "again", PAGES["article"][0], 2), (None, None, PAGES["bare"][0], 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    tree = op11_html.trained(spark)
    found = op11_html.main_texts(pages, tree).collect()
    texts = {r.url: r.text for r in found}
    for name, (_, text) in PAGES.items():
        assert texts[f"http://x/{name}"] == text, name
    assert len(found) == len(rows) and texts["again"] == PAGES["article"][1] and texts[None] == PAGES["bare"][1]
    assert op11_html.main_texts(pages.limit(0), tree).count() == 0


def test_main_text_long(spark):
    """Whole texts of very long pages, and time that doesn't grow with their square."""
    long = "".join(f"<p>{P1} {k}</p>" for k in range(30_000))
    odd = ["<article><p>" + P1 + "</p>" + "<a \"" * 200_000, "<div>" * 100_000 + P1, "<" * 300_000, "<p>" + "a < b " * 100_000 + "</p>", "<!--" * 100_000, "</section>" * 200_000]
    pages = spark.createDataFrame([(0, "u", f"<nav><a href=/>x</a></nav><article>{long}</article>"), *((i + 1, "u", x) for i, x in enumerate(odd))], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in op11_html.main_texts(pages).collect()}
    assert texts[0].split("\n\n") == [f"{P1} {k}" for k in range(30_000)]
    assert texts[1] == P1 and len(texts) == 7


def test_tree_fits_its_table(spark):
    rows = op11_html.labelled()
    tree = op11_html.trained(spark, rows)
    said = tree.main(np.array([v for v, _ in rows]))
    right = said == np.array([y > 0.5 for _, y in rows])
    assert right.mean() > 0.97 and len(rows) < 1500 and len(tree.nodes) < 200
    used = {op11_html.FEATURES[int(n[0])] for n in tree.nodes if n[0] >= 0}
    assert used & {"words", "words_before", "words_after"} and used & {"links", "links_before", "links_after"}


# --- 12 ---


def codes_brute(rows, entries=64, parts=16, scale=256, rounds=2):
    rows = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    length = min(Counter(len(r[1]) for r in rows).items(), key=lambda x: (-x[1], x[0]))[0] if rows else 0
    rows = sorted((r for r in rows if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is not None, r[2] or 0))
    if not rows:
        return []
    v = [[int(np.floor(scale * x)) for x in r[1]] for r in rows]
    cuts = [(i * length // parts, (i + 1) * length // parts) for i in range(parts)]
    books = [[x[a:b] for x in v[:entries]] for a, b in cuts]
    dist = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    pick = lambda x, book: min((dist(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for (a, b), book in zip(cuts, books):
            groups = defaultdict(list)
            for x in v:
                groups[pick(x[a:b], book)[1]].append(x[a:b])
            for k, g in groups.items():
                book[k] = [sum(c) // len(g) for c in zip(*g)]
    best = [[pick(x[a:b], book) for (a, b), book in zip(cuts, books)] for x in v]
    error = [sum(d for d, _ in p) for p in best]
    sums = defaultdict(int)
    for r, e in zip(rows, error):
        sums[r[2]] += e
    h = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in p), e, sums[r[2]], h) for r, p, e in zip(rows, best, error)]


def vectors(n, seed=3, width=32):
    rng = random.Random(seed)
    made = [(i, [rng.choice([rng.gauss(0, 0.2), 0.0, -0.5]) for _ in range(width)], rng.choice([1, 1, 1, 2, None]), "x") for i in range(n)]
    return made + [(n, made[3][1], 2, "x"), (n + 1, made[3][1], 1, "x"), (5, made[3][1], 1, "x"), (5, made[3][1], 1, "x"), (None, made[4][1], None, "x"), (n + 2, None, 1, "x"), (n + 3, [], 1, "x"), (n + 4, [None] * width, 1, "x"), (n + 5, [float("nan")] * width, 1, "x"), (n + 6, [1.0] * 8, 1, "x"), (n + 7, [float("inf")] * width, 1, "x"), (n + 8, [0.0] * width, 1, "x")]


@pytest.mark.parametrize("n", [6, 20, 700])
def test_codes(spark, n):
    rows = vectors(n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").repartition(4)
    rows = [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], b) for a, v, b, _ in rows]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in op12_codes.compress(df).collect()), key=key) == sorted(codes_brute(rows), key=key)
    if n == 6:
        assert op12_codes.compress(df.limit(0)).count() == 0


def test_ball_tree():
    """Exact with ties, equal entries and one entry; distances that the tree leaves out."""
    rng = np.random.default_rng(4)
    for k, d, spread in [(1, 3, 5), (64, 4, 3), (64, 4, 200), (200, 2, 1 << 26), (64, 1, 1), (64, 0, 1)]:
        book, points = rng.integers(-spread, spread + 1, (k, d)), rng.integers(-spread, spread + 1, (3000, d))
        tree = op12_codes.BallTree(book)
        index, best = tree.nearest(points)
        every = ((points[:, None, :] - book) ** 2).sum(-1)
        assert (index == every.argmin(1)).all() and (best == every.min(1)).all()
        if (k, d, spread) == (64, 4, 200):
            assert tree.scored < 0.5 * every.size
    with pytest.raises(OverflowError):
        op12_codes._integers(op12_codes.pa.array([[1e9] * 16]), 256, 16)


# --- 13 ---


def variants_brute(docs):
    n = Counter()
    low = str.maketrans(op13_variants.UPPER, op13_variants.LOWER)
    for i, text, *_ in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    of = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(x, key=lambda y: (-n[y], y)) for w, x in of.items() if x}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(of[w]), n[form[w]] if w in form else None))
    return sorted(out)


def texts(seed=5, n=150):
    rng = random.Random(seed)
    stems = ["garden", "aaaaa", "stone", "überÿ", "þorn×", "mañana", "riverbank", "bananas", "ababab", "x" * 90]

    def word():
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é", "x"])
        return "".join(w)

    docs = [(i, " ".join(rng.choice([word(), word().upper()]) for _ in range(rng.choice([0, 5, 60]))) + rng.choice([".", "!1 ", "ŵ"]), "w") for i in range(n)]
    docs.append((n + 20, "lantern " * 40 + "lanterm " * 15 + "lanzerm " * 5, "w"))  # a chain of forms
    return [*docs, docs[3], docs[3], (None, docs[4][1], "w"), (n, None, "w"), (n + 1, "", "w"), (n + 2, "garden1garden_garden " * 3000 + "verylongword" * 900 + " ", "w")] + [(n + 3 + i, "verylongword" * 900 + "e" * (i % 2), "w") for i in range(8)]


def test_variants(spark):
    docs = texts()
    df = spark.createDataFrame(docs, "doc_id long, text string, word string").repartition(3)
    expected = variants_brute(docs)
    assert sorted((tuple(r) for r in op13_variants.variants(df).collect()), key=lambda r: r[0]) == expected
    assert sum(r[1] is not None for r in expected) > 20 and any(r[2] not in (r[0], r[1]) for r in expected)
    assert op13_variants.variants(df.limit(0)).count() == 0


def test_large_cells(spark):
    """Cells beyond the bound are dealt position by position, with the same pairs, each once in either direction."""
    rng = random.Random(8)
    some = sorted({"ab" + "".join(rng.choice("abcdé") for _ in range(rng.choice([3, 4, 4]))) for _ in range(4000)} | {"".join(rng.choice("ab") for _ in range(6)) for _ in range(60)})
    vocabulary = spark.createDataFrame([(w, len(w) * 10) for w in some], "word string, n long")
    whole = sorted(tuple(r) for r in op13_variants.near(vocabulary, most=1 << 30).collect())
    dealt = sorted(tuple(r) for r in op13_variants.near(vocabulary, most=1, each=500).collect())
    cells = op13_variants._cells(vocabulary, 5).groupBy("cell").count()
    assert cells.filter("count > 512").count() > 0
    assert whole == dealt and len(set(whole)) == len(whole)
    left = defaultdict(set)
    for w in some:
        for i in range(len(w)):
            left[w[:i] + "*" + w[i + 1 :]].add(w)
    expected = {(a, b) for g in left.values() for a in g for b in g if a != b} | {p for w in some for i in range(len(w)) if (d := w[:i] + w[i + 1 :]) in set(some) for p in ((w, d), (d, w))}
    assert {(a, b) for a, b, _ in whole} == expected and all(n == 10 * len(b) for _, b, n in whole)


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 100, 129):
        order = rng.permutation(n)
        tree = op13_variants.WaveletTree(order)
        a, low = rng.integers(0, n, 50), rng.integers(0, n, 50)
        b, high = np.minimum(n, a + rng.integers(0, n + 1, 50)), np.minimum(n, low + rng.integers(0, n + 1, 50))
        q, v = tree.report(a, b, low, high)
        assert sorted(zip(q.tolist(), v.tolist())) == sorted((k, int(y)) for k in range(50) for y in order[a[k] : b[k]] if low[k] <= y < high[k])
