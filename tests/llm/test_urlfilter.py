import random
import re
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F
from tidemark.llm import urlfilter

SCHEMA = "page_id long, url string, html string, host string, node string"
CANON = '<LINK href="{}" rel=canonical>'


def verdicts(spark, rows, **kw):
    df = spark.createDataFrame([(i, u, h, "clash", None) for i, (u, h) in enumerate(rows)], SCHEMA)
    return {r["page_id"]: r for r in urlfilter.judge(df, urlfilter.RULES, **kw).collect()}


def test_rules_and_parts(spark):
    rows = [
        ("http://A.Example.ORG/es/1?x#y", None), ("https://example.org/en/12", ""), ("https://example.org/en/2", None), ("http://myexample.org/es/", None),
        ("http://a.com/de/", None), ("http://a.com/fr/x", None), ("http://a.com/it", None), ("http://org", None), ("nothing", None), (None, None),
        ("://h?//a/b", None), ("x://É.Com/De/://z", None), ("http://a.com/de/", None),
    ]
    got = verdicts(spark, rows)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(rows))] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("myexample.org", "/es/", "org/", "allow"),
        ("a.com", "/de/", "com/de/", "block"), ("a.com", "/fr/x", "com/fr/", "allow"), ("a.com", "/it", None, "allow"), ("org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("h", "", None, "allow"), ("É.com", "/De/://z", None, "allow"), ("a.com", "/de/", "com/de/", "block"),
    ]


def test_blocks_reach_aliases_and_allow_has_precedence(spark):
    rows = [
        ("http://a.net/1", CANON.format("http://B.net/2#frag")),  # 0: alias chain to a blocked page
        ("http://b.net/2", '<meta http-equiv="Refresh" content="0; URL=http://x.com/de/9">'),
        ("http://c.net/1", CANON.format("//x.com/de/9")),
        ("http://c.net/1#top", None),  # 3: the same node
        ("http://x.com/fr/1", CANON.format("/de/7")),  # 4: allowed by its own rule, in a group with a blocked one
        ("http://d.net/1", CANON.format("http://x.com/fr/1")),  # 5: the permission of 4 is its own
        ("http://e.net/", CANON.format("relative")),
    ]
    got = verdicts(spark, rows)
    assert [got[i]["verdict"] for i in range(7)] == ["block", "block", "block", "block", "allow", "block", "allow"]
    assert got[0]["alias_urls"] == 4 and got[6]["alias_urls"] == 2


def plain_node(url):
    p = urlsplit(url)
    return f"{p.scheme}://{p.netloc.lower()}{p.path}{'?' + p.query if p.query else ''}"


def test_targets_resolve_as_in_a_browser(spark):
    bases = ["http://h.net/a/b/c?q=1", "http://h.net", "http://h.net/a/"]
    refs = ["page2.html", "../x", "./y/../z?k=1&l=/../", "?p=2", "/r/./s", "//o.net/t", "https://o.net/u/v", "..", "../../../w/", "#top", "mailto:a@b"]
    rows = [(b, CANON.format(r.replace("&", "&amp;"))) for b in bases for r in refs]
    df = spark.createDataFrame(rows, "url string, html string").withColumn("t", urlfilter.link_targets(F.col("url"), F.col("html")))
    got = [r["n"] for r in df.select(F.transform("t", urlfilter.node_of).alias("n")).collect()]
    for (base, _), ref, nodes in zip(rows, refs * len(bases), got, strict=True):
        want = None if ref.startswith("mailto") else plain_node(urljoin(base + ("/" if base.endswith(".net") and ref[0] not in "?#" else ""), ref))
        assert nodes == [want], (base, ref, nodes, want)


def test_all_tags_and_the_base_tag_count(spark):
    html = '<base href="/deep/"><link rel="x Canonical y" href="one"><LINK rel=\'canonical\' href=\'two three\'><meta content="5;url=&#39;four&#39;" http-equiv=refresh><link rel="canonicals" href="no">'
    df = spark.createDataFrame([("http://h.net/a", html), ("http://h.net/a", None), ("x\n://h/p\nq?\n#", CANON.format("r"))], "url string, html string")
    got = [r["t"] for r in df.select(urlfilter.link_targets(F.col("url"), F.col("html")).alias("t")).collect()]
    assert got[0] == ["http://h.net/deep/one", "http://h.net/deep/two three", "http://h.net/deep/four"] and got[1] is None
    assert [r["n"] for r in df.select(urlfilter.node_of(F.col("url")).alias("n")).collect()][2] == "x\n://h/p\nq?\n"


def test_random_pages_against_union_find(spark):
    rng = random.Random(12)
    hosts = ["a.net", "x.com", "s.example.org", "Y.net"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'es', 'it'])}/{rng.randrange(9)}" for _ in range(150)]
    rows = [(u, "".join(CANON.format(rng.choice([rng.choice(urls), f"../{rng.choice(['de', 'it'])}/{rng.randrange(9)}", str(rng.randrange(9))])) for _ in range(rng.choice([0, 0, 1, 2])))) for u in urls]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, html in rows:
        for ref in re.findall('href="(.*?)"', html):
            root[find(plain_node(u))] = find(plain_node(urljoin(u, ref)))

    def rule(node):
        p = urlsplit(node)
        fits = [r for r in urlfilter.RULES if (p.netloc == r.host or p.netloc.endswith("." + r.host)) and p.path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)).verdict if fits else None

    blocked = {find(x) for x in list(root) if rule(x) == "block"}
    got = verdicts(spark, rows)
    for i, (u, _) in enumerate(rows):
        node = plain_node(u)
        assert got[i]["verdict"] == (rule(node) or ("block" if find(node) in blocked else "allow")), u
    assert {r["verdict"] for r in got.values() if r["rule"] is None} == {"allow", "block"}


def test_redirect_column_and_empty(spark):
    assert verdicts(spark, [("http://a.net/1", None)], redirect_col="node")[0]["verdict"] == "allow"
    assert verdicts(spark, []) == {}
