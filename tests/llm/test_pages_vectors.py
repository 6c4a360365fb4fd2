"""Page, URL and vector operators against brute force on small tables."""

import html
import re

import numpy as np
from pyspark.sql import functions as F

from fleetpulse.llm import html_tree, rotation_codes, url_cascade
from fleetpulse.llm.components import component_roots
from fleetpulse.llm.queries import LISTED_LABELS, URL_RULES

PAGE = """<body><div class="cookie-notice"><p>We use cookies, a lot of them. Accept them.</p></div>
<header><h2>Site</h2></header><article><header><h1>A &lt; B &amp; C</h1></header><p>One two
 three.<script>var x = "<p>no</p>";</script><div><p>Deep text with enough words.</p></div>
<aside><p>Related things you may like to read.</p></aside></article>
<section id="comments"><div><p>Nice article, thank you.</p></div></section>
<form><label>Mail</label></form><footer><p>Copyright someone.</p></footer>"""


def _expected(page):
    inner = re.search(r"(?s)<article>(.*?)(</article>|$)", page).group(1)
    blocks = re.split(r"</?p>|</?h1>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_main_texts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_tree.train(pages)
    source = {r.page_id: r.html for r in pages.collect()}
    for row in html_tree.main_texts(pages.withColumn("text", F.lit(1)), model).collect():
        assert row.text == _expected(source[row.page_id])
        assert row.n_chars == len(row.text)
    assert model.text(PAGE) == "A < B & C\n\nOne two three.\n\nDeep text with enough words."
    assert model.text(None) == model.text("") == ""
    assert model.text("<p>" * 5000 + "x") == "x"
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>a")],
                                "page_id long, url string, html string")
    found = html_tree.main_texts(odd, model)
    assert sorted(r.text for r in found.collect())[:2] == ["", ""]
    assert html_tree.main_texts(odd.limit(0), html_tree.train(odd.limit(0))).count() == 0


def test_marginals_are_exact():
    """Messages give the same marginals as summing over all labellings."""
    model = html_tree.fit([PAGE, "<nav><li><a>Menu</a></nav><article><p>Some text.</article>"])
    nodes = html_tree.parse("<body><div id=sidebar><p>Links.</p></div><main><h1>T</h1><p>x y.")
    total, inside = 0.0, np.zeros(len(nodes))
    for bits in range(2 ** len(nodes)):
        labels = [(bits >> i) & 1 for i in range(len(nodes))]
        weight = 0.5
        for node, label in zip(nodes, labels, strict=True):
            for name in node.features:
                weight *= model.feature.get(name, (1, 1))[label]
            if node.parent >= 0:
                kind = html_tree._kind(nodes[node.parent])
                weight *= model._edge(kind, labels[node.parent])[label]
        total += weight
        inside += weight * np.array(labels)
    assert np.allclose(model.marginals(nodes), inside / total)


URLS = [
    None, "", "no scheme", "http://a.org", "http://a.org/x", "HTTPS://A.Example.ORG/es/1?x#y",
    "http://example.org/en/1", "http://example.org/en/12/", "http://myexample.org/es/",
    "http://spam-farm.x.net/", "http://cheap-pills.com/fr/", "x://b.com/de/z", "http://?q/es/",
    "http://spam-farm.x.net/", "http://org/", "http://example.org?/es/", "a://b://c.org/",
]


def _verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in URL_RULES:
        own, slash, way = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + way):
            fits.append((len(rule), rule, verdict))
    listed = set(host.split(".")) & set(LISTED_LABELS)
    _, rule, verdict = max(fits, default=(0, None, "block" if listed else "allow"))
    return host, path, rule, verdict


def test_urls_equal_brute_force(spark):
    data = [(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], "h"), (4, URLS[4], "h")]
    pages = spark.createDataFrame(data, "page_id long, url string, host string")
    found = url_cascade.judge_urls(pages, URL_RULES, LISTED_LABELS).collect()
    expected = sorted(((i, *_verdict(u)) for i, u, _ in data), key=repr)
    assert sorted(map(tuple, found), key=repr) == expected
    assert url_cascade.judge_urls(pages.limit(0), URL_RULES, LISTED_LABELS).count() == 0
    assert {r.verdict for r in url_cascade.judge_urls(pages, (), ()).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(
        F.concat(F.lit("key "), "id").alias("key"), (F.xxhash64("id") % 7 == 0).alias("listed")
    )
    cascade = url_cascade.Cascade(universe)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.has(F.col("key")) != F.col("listed"))
    assert wrong.count() == 0


def _brute_vectors(data):
    good = [k for k, (_, v) in enumerate(data)
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(data), list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in good:
        for q in good:
            a, b = np.array(data[p][1]), np.array(data[q][1])
            if p < q and len(a) == len(b):
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                    links[p] += 1
                    links[q] += 1
                    low, high = sorted((find(p), find(q)), key=lambda k: data[k][0])
                    root[high] = low
    return sorted((i, links[k], data[find(k)][0], find(k) == k) for k, (i, _) in enumerate(data))


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rotation_codes, "BLOCK", 8)  # many pairs of blocks
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    data = [
        (i, (base[i % 30] * rng.uniform(0.5, 9) + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])).tolist())
        for i in range(300)
    ]
    data += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15),
             (904, [None] + [1.0] * 15), (905, data[0][1]), (906, [float("inf")] * 16),
             (907, [1.0, 2.0]), (908, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in data],
                               "vec_id long, embedding array<double>, node int").repartition(3)
    found = sorted(map(tuple, rotation_codes.near_vectors(df).collect()))
    assert found == _brute_vectors(data)
    assert rotation_codes.near_vectors(df.limit(0)).count() == 0
    repeated = rotation_codes.near_vectors(df.union(df.where("vec_id = 905")))
    assert repeated.count() == len(data) + 1


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    unit = rng.normal(size=(400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned, signs, factor = rotation_codes.codes(unit)
    estimate, spread = rotation_codes.estimates(signs, factor, turned)
    error = estimate - unit @ unit.T
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= spread[:, None]).mean() > 0.9999


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in component_roots(df).collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {200 + i: 100 for i in range(50)}
    assert component_roots(df.limit(0)).count() == 0
