"""Operators 11, 12 and 13: held-out pages, and brute force over small tables with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from cotejo.llm import filter_audit, page_blocks, page_text, vector_codes
from pyspark.sql import functions as F

LONG = "The council met on Tuesday evening to discuss the repair of the old bridge, which has been closed to traffic since March of last year."

#: Pages of layouts that the labelled table doesn't hold, with the article's blocks.
HELD_OUT = [
    (
        f"""<html><head><title>Bridge</title><style>p{{}}</style></head><body class="has-sidebar"><div id="topbar"><a href=/>Home</a></div>
        <div class="cookie-banner">We use cookies to make this site better for you and for all of our partners.</div>
        <div class="wrapper menu-open"><article class="post"><header class="entry-header"><h1>Bridge &amp; road</h1><p>By A. Writer</p></header>
        <p>{LONG}</p><aside>Read this too: {LONG}</aside><p>Short one.</p><ul><li>First &eacute;tape</li><li>Second</li></ul>
        <script>var x = "<p>no</p>";</script><p>{LONG} <a href=x>See here</a>&nbsp; now.</p></article>
        <section id="comments"><article><p>{LONG}</p></article><article><p>I agree with all of it.</p></article></section></div>
        <form><label>Your name</label><p>Write a comment of your own below.</p></form><footer>&copy; 2020 The Paper</footer></body></html>""",
        ["Bridge & road", "By A. Writer", LONG, "Short one.", "First étape", "Second", f"{LONG} See here now."],
    ),
    (
        f"""<div class=nav-main><ul><li><a>One</a><li><a>Two</a></ul></div><div class=sidebar><p>{LONG}</p></div>
        <div class=content><h2>Title</h2>{LONG}<br>{LONG}<p>{LONG}</div><div class="Footer-Links"><a>Imprint</a> <a>Terms</a></div>""",
        ["Title", f"{LONG} {LONG}", LONG],
    ),
    (f"<div><a>Home</a> | <a>News</a> | <a>Sport</a></div><div><h1>Title of it</h1><p>{LONG}</p><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div><a>Imprint</a></div>", ["Title of it", LONG, LONG, "Yes.", LONG]),
    (f"<nav>Menu</nav><main><p>{LONG}</p><div class='ad-box'>Buy now!</div><pre>x  =\n1</pre></main>", [LONG, "x = 1"]),
    (f"<nav><a>Home</a></nav><div>Buy two, get one.</div><article><div>A title</div><section><div>{LONG}</div><div>So.</div></section><div>{LONG} <a>{LONG}</a></div><div><a>Share</a></div></article><div>Last words here.</div>", ["A title", LONG, "So.", f"{LONG} {LONG}"]),
    ("<div role=navigation><a>One</a></div><article><p>Just this.</article><div class=comments>" + f"<p>{LONG}</p>" * 3, ["Just this."]),
]


def test_pages_of_other_layouts(spark):
    rows = [(k, None, h) for k, (h, _) in enumerate(HELD_OUT)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), page_text.train(spark)).collect()
    assert {r.page_id: r.text.split("\n\n") for r in got} == {k: want for k, (_, want) in enumerate(HELD_OUT)}
    assert all(r.n_chars == len(r.text) for r in got)


def test_pages_edge_cases(spark):
    long = "word " * 200_000
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, None, "<"), (3, "a", "no tags at all, but a < b and 3 > 2"), (4, "a", f"<article><p>{long}"), (5, "a", "<p <p '\"><a href=\"" * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("blocks", F.lit(1)).withColumn("text", F.lit(2))
    tree = page_text.train(spark)
    got = page_text.extract(df, tree).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter(r[:2] for r in rows)
    text = {r.page_id: r.text for r in got}
    assert text[1] == text[None] == "" and text[4] == long.strip()
    assert page_text.extract(df.limit(0), tree).collect() == []


def test_page_blocks():
    found = page_blocks.blocks("<ul><li>a <b>b</b>c<li><a href='>'>d</a></ul><!-- <p>x</p> --><p>&lt;p&gt; &amp;amp;<br>e")
    assert [(b.text, b.words, b.letters, b.linked) for b in found] == [("a bc", 2, 3, 0), ("d", 1, 1, 1), ("<p> &amp; e", 3, 9, 0)]


def test_tree_as_a_column(spark):
    """The compiled tree says of every labelled block what pyspark.ml's own tree says."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = spark.createDataFrame([(h,) for h in page_text.pages()], "html string")
    found = page_text.with_blocks(rows, "html").select(F.explode(page_text.featured("blocks")).alias("b")).select("b", "b.*")
    found = found.withColumn("label", F.startswith("text", F.lit(page_text.MARK)).cast("double"))
    vectors = VectorAssembler(inputCols=list(page_text.FEATURES), outputCol="features").transform(found)
    tree = DecisionTreeClassifier(maxDepth=page_text.DEPTH, minInstancesPerNode=page_text.LEAF, maxBins=256, seed=1).fit(vectors)
    assert tree.toDebugString.splitlines()[1:] == page_text.train(spark).splitlines()[1:]
    got = tree.transform(vectors).select("prediction", "label", page_text.rule(tree.toDebugString, F.col("b")).alias("kept")).collect()
    assert len(got) > 100 and all((r.prediction > 0.5) == r.kept for r in got)
    assert sum(r.kept == bool(r.label) for r in got) / len(got) > 0.95


def compress_plainly(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    size = -(-max(len(r[1]) for r in kept) // 4)
    whole = [np.array([int(np.floor(1024 * float(x))) for x in r[1]] + [0] * (4 * size - len(r[1]))) for r in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is not None, kept[k][0] or 0, list(whole[k])))[:256]
    books = [[whole[k][p * size : (p + 1) * size] for k in order] for p in range(4)]

    def nearest(x, book):
        return min((int(((x - c) ** 2).sum()), k) for k, c in enumerate(book))

    for _ in range(4):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for v in whole:
                x = v[p * size : (p + 1) * size]
                held[nearest(x, book)[1]].append(x)
            for k, xs in held.items():
                book[k] = np.array([int(s) // len(xs) for s in np.sum(xs, 0)])
    out = []
    for (i, _, label), v in zip(kept, whole):
        best = [nearest(v[p * size : (p + 1) * size], books[p]) for p in range(4)]
        out.append([i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)])
    sums = Counter()
    for _, label, _, error in out:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, label, code, error, sums[label], digest) for i, label, code, error in out)


@pytest.mark.parametrize("n, length", [(700, 8), (40, 6), (3, 4)])
def test_vector_codes(spark, n, length):
    rng = random.Random(n)
    # Few values, so that ties are many.
    rows = [(k * 37 % n, [rng.choice([-1.0, -0.3, 0.0, 0.001, 0.5]) * (1 + k % 3) for _ in range(length)], rng.choice([None, 0, 1])) for k in range(n)]
    rows += [(None, [0.1] * length, 5), (None, [0.1] * length, 5), rows[0], (7, None, 1), (8, [None] * length, 1), (9, [float("nan")] * length, 2), (10, [float("-inf")] + [0.0] * (length - 1), 2)]
    rows += [(11, [0.25] * (length - 2), None), (12, [], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("l", F.lit(1)).withColumn("v", F.lit(2))
    got = Counter((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df.repartition(3)).collect())
    plain = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert got == compress_plainly(plain)
    assert vector_codes.compress(df.filter("vec_id in (8, 9)").filter("label = 9")).collect() == []


def test_orchard_search_is_exact():
    rng = np.random.default_rng(2)
    for size in (1, 2, 9, 256):
        entries, x = rng.integers(-4, 5, (size, 3)), rng.integers(-6, 7, (3000, 3))
        apart = ((x[:, None] - entries[None]) ** 2).sum(2)
        code, gap = vector_codes.Codebook(entries).search(x)
        assert (code == apart.argmin(1)).all() and (gap == apart.min(1)).all()


def audit_plainly(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        least[t or ""] = min(least.get(t or "", (True, math.inf)), (i is not None, i or 0))
    parts = defaultdict(list)
    for i, t, source in docs:
        text = t or ""
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        words = [w for w in text.split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t or "") > 5 * len(t or "")}
        fails |= {"D": any(c in "#$%&*|" for c in t or ""), "E": (i is not None, i or 0) > least[t or ""]}
        parts[source or ""].append((i, {f for f, bad in fails.items() if bad}))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                failing = [r for r in rows if f in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = (f, len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in rows), sum(i is not None and i in good for i, _ in gone), sum(i is not None and i in toxic for i, _ in gone))
        for k, v in out.items():
            if k[0] == part:
                out[k] = (*v, shapley[v[0]])
    return out


def test_filter_audit(spark):
    rng = random.Random(5)
    texts = ["", None, "one two", "A B C " * 30, "word " * 60, " ".join(f"w{k}" for k in range(70)), " ".join(f"w{k}" for k in range(60)) + " #", "x\ty z " * 40, "é" * 300]
    docs = [(rng.randrange(400), rng.choice(texts), rng.choice(["web", "books", "", None])) for _ in range(300)] + [(None, "one two", "web"), (None, "one two", "web"), (None, "fresh", None)]
    labels = [(rng.randrange(400), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1)]
    own = {c: F.lit(0) for c in ("mask", "n", "part", "digest", "held", "first", "good", "t", "w")}
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns(own)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns(own)
    got = filter_audit.audit(filter_audit.masks(df, known)).collect()
    want = audit_plainly(docs, labels)
    assert len(got) == len(want) == 3 * 600
    assert {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    assert filter_audit.audit(filter_audit.masks(df.limit(0), known)).collect() == []
    assert len(filter_audit.audit(filter_audit.masks(df.limit(1), known.limit(0))).collect()) == 600
