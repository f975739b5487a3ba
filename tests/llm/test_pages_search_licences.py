"""HTML extraction, exact top-k and licence scans against brute force and planted cases."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import html as X
from gridloom.llm import licenses as L
from gridloom.llm import topk as T

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><nav>Home</nav><main><article class="post"><header><h1>Title &amp; co</h1><p class="byline">by X</p></header>
<p>One<br>two <b>three</b>
 four&nbsp;five<p>Second<ul><li>a<li>b</ul><table><tr><td>c1<td>c2</table><div class="share-buttons">Share</div><form>Name <input></form><aside>rel</aside><pre>x  y</pre></article>
<section id="comments"><article class="comment"><p>Nice</p></article></section></main><div class="sidebar">S</div><footer>F</footer><script>var a="<p>no</p>"</script></body></html>"""


def text(html, noise=()):
    return X.main_text(html, frozenset(noise))


def test_one_page():
    assert text(PAGE) == "Title & co\nOne two three four five\nSecond\na\nb\nc1\nc2\nx y"


def test_odd_pages():
    assert text(None) == "" and text("") == ""
    assert text("plain text") == "plain text"
    assert text("a < b <c") == "a < b <c"
    assert text("<div class=menu>m</div><div><p>Plain <i>text</i> here</div>tail") == "Plain text here\ntail"
    assert text("<article><p>x</article>y") == "x"
    assert text("<script>never closed <p>no") == ""
    assert text("<article><p>" + "<b>" * 3000 + "deep</article>") == "deep"
    assert text("<article>" + "<a " * 20000) is not None
    assert text("<ARTICLE><P CLASS='x'>Up</P></ARTICLE>") == "Up"
    assert text("<p>a</p><!-- <p>no</p> --><p>b &lt;c&gt; &#233;</p>") == "a\nb <c> é"


def page(host, i, body):
    return (i, f"https://{host}/p/{i}", body)


def test_site_tree_cuts_what_every_page_repeats(spark):
    rows = [page("a.org", i, f"<html><body><div class='x7'><span>Same strip on all pages</span></div><div class='c'><p>Own text of page {i}</p><p>more {i * 17}</p></div><div class='y'>All rights {'kept'}</div></body></html>") for i in range(12)]
    rows += [page("b.org", 100 + i, "<html><body><div><p>One and the same page</p></div></body></html>") for i in range(6)]  # copies
    rows += [(200, None, None), (201, "https://a.org/p/1", None), rows[0]]
    df = spark.createDataFrame([(*r, "t", 5, "n") for r in rows], "page_id long, url string, html string, text string, n_chars int, noise string")
    got = X.extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["text"] == f"Own text of page {i}\nmore {i * 17}" for i in range(12))
    assert all(by[100 + i]["text"] == "One and the same page" for i in range(6))
    assert by[200]["text"] == "" and by[201]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert X.extract(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vecs = {i: rng.normal(0, 0.2, 8).astype(np.float32).tolist() for i in range(300)}
    for i in range(100, 160):
        vecs[i] = vecs[100]  # a third of ties
    rows = list(vecs.items()) + [(300, None), (301, [1.0, None, 2.0]), (302, [math.nan] * 8), (303, [math.inf] + [0.0] * 7), (304, [0.5] * 3), (None, [0.1] * 8), (7, vecs[7]), (150, vecs[150])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    ok = [(i, np.floor(256 * np.array([*v, *[0.0] * (8 - len(v))], float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, vq in dict((i, v) for i, v in ok if i % 50 == 0).items():
        best = sorted(((-int(vq @ v), i) for i, v in ok if i != q))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    got = [tuple(r) for r in T.top_k(df.filter("vec_id % 50 = 0"), df).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)


def test_top_k_of_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in T.top_k(df.filter("vec_id = 0"), df).collect()] == [(0, 1, 1, 256 * 256 + 512 * 128)]
    assert T.top_k(df.limit(0), df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e12, 1.0]), (1, [1e12, -3.0]), (2, [-1e12, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in T.top_k(big.filter("vec_id = 0"), big).orderBy("rank").collect()]
    assert got[0][0] == 1 and got[1][0] == 2 and got[0][1] == 1 << 62 and got[1][1] == -(1 << 62)


def words(t):
    return [w for w in re.split(r"[^\w.]+", re.sub(r"\.(?![0-9])", " ", t.lower().replace("_", " "))) if w]


def cosine_to_templates(unit, df, n):
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1
    vec = lambda t: {w: c * idf(w) for w, c in Counter(words(t)).items()}
    u = vec(unit)
    best = (0, "")
    for name, t in L.TEMPLATES:
        v = vec(t)
        dot = sum(x * v.get(w, 0) for w, x in u.items())
        c = round(dot / math.sqrt(sum(x * x for x in u.values())) / math.sqrt(sum(x * x for x in v.values())), 6)
        best = max(best, (c, name), key=lambda b: (b[0], [-ord(ch) for ch in b[1]]))
    return best


def test_licences(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "print(1)"), (3, "a/b/d/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/d/e/f.c", "int x"), (5, "z/q", None), (6, None, "Licensed under the Apache License, Version 2.0."), (7, "top", "the license of it all was lost and the copyright is whatever"),
        (7, "top", ""), (8, "a/x.c", "code\n" * 20 + "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with it.\nmore code"), (9, "a/b/c.py", "print(1)"),
    ]
    df = spark.createDataFrame([(*f, "l", 1.0) for f in files], "doc_id long, path string, text string, license string, cosine double")
    got = L.scan(df).collect()
    assert len(got) == len(files)
    by = {r["doc_id"]: r for r in got}
    found = {k: (r["license"], r["found"], r["from_path"]) for k, r in by.items()}
    assert found[1] == ("MIT", "file", "a/LICENSE") and found[2] == found[9] == ("MIT", "inherited", "a/LICENSE")
    assert found[3][:2] == ("GPL-3.0", "file") and found[4] == ("GPL-3.0", "inherited", "a/b/d/COPYING")
    assert found[5] == (None, None, None) and found[6][0] == "Apache-2.0" and found[7] == (None, None, None)
    assert found[8][:2] == ("Apache-2.0", "header")
    n = len(files)
    vocabulary = {w for _, t in L.TEMPLATES for w in words(t)}
    dfs = Counter(w for *_, t in files for w in set(words(t or "")) & vocabulary)
    for k in (1, 3, 6, 8):
        text_ = next(t for i, _, t in files if i == k)
        line = next(x for x in text_.split("\n") if "icense" in x)
        c, name = cosine_to_templates(line, dfs, n)
        assert by[k]["license"] == name and abs(by[k]["cosine"] - c) < 2e-6
    assert L.scan(df.limit(0)).count() == 0


def test_faulty_markup_keeps_the_main_text():
    """A theme's class words on wrappers, stray quotes, headings called headers, many unclosed tags."""
    from gridloom.llm.html import main_text

    none = frozenset()
    assert main_text("<body class='home has-sidebar comments-open'><p>one</p><nav>x</nav><footer>f</footer>", none) == "one"
    assert main_text("<p class=x data-n=it's>Hello <b title=\"a > b\">w</b></p>", none) == "Hello w"
    assert main_text("<h2 class='page-header'>T</h2><p>x</p><div class='sidebar'>s</div>", none) == "T\nx"
    assert main_text("<nav>" + "<font>" * 300 + "menu</nav><p>main", none) == "main"
    assert main_text("<div class='page-widget'><article><h1>A</h1><p>t</p></article><div class=comments>c</div></div>", none) == "A\nt"
    assert main_text("<div class='site banner'><p>only text</p></div>", none) == "only text"
    assert main_text("<article><header><h1>T</h1></header><p>x</p><div class=comments><p>no</p></div></article>", none) == "T\nx"


def test_the_tree_finds_partly_repeated_blocks_without_any_telling_name(spark):
    """Menus that show some of a site's entries, and footers of a few kinds, go by their entropy alone;
    the statistics equal a plain count."""
    import math
    import random
    from collections import Counter

    from gridloom.llm import html as W

    r = random.Random(3)
    entries = [f"entry{k}" for k in range(8)]
    rows = []
    for k in range(40):
        menu = "".join(f"<li><a>{e}</a></li>" for e in r.sample(entries, 4))
        body = " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
        rows.append((k, "http://a.example/x", f"<div class=q><ul>{menu}</ul></div><div class=z><p>{body}</p></div><div class=u>Imprint, version {k % 3}</div>"))
    rows.append((99, "http://b.example/", "<div><p>alone on its host</p></div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in W.extract(pages).collect()}
    assert all(got[k] == rows[k][2].split("<p>")[1].split("</p>")[0] for k in range(40))
    assert got[99] == "alone on its host"

    seen = [W.statistics(h) for _, u, h in rows if "a.example" in u]
    counts = Counter(f for page in seen for f in page)
    nodes = sorted({(k, up) for k, up, _, _ in counts})
    of = lambda k, kind: [c for (a, _, b, _), c in counts.items() if (a, b) == (k, kind)]
    log = lambda k, kind, w: sum(c**w * math.log(c) for c in of(k, kind))
    prior = {k: min(f for a, _, kind, f in counts if a == k and kind == W.PAGES) for k, _ in nodes}
    noise = W.tree_noise([k for k, _ in nodes], [u for _, u in nodes], [sum(of(k, W.PAGES)) for k, _ in nodes], [len(of(k, W.TEXTS)) for k, _ in nodes], [log(k, W.TEXTS, 0) for k, _ in nodes], [len(of(k, W.LAYOUTS)) for k, _ in nodes], [log(k, W.LAYOUTS, 1) for k, _ in nodes], [prior[k] for k, _ in nodes])
    found = {x["host"]: x["noise"] for x in W.site_noise(pages.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))).collect()}
    assert sorted(noise) == found["a.example"]
