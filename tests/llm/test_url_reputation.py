"""Rules against a plain reading, and shrinkage through the levels."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from raterlake.llm import common, url_reputation

from ..conftest import SF


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def rule(host, path):
    fits = [r for r in url_reputation.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/7?x", "https://www.example.com/en/77/a#b", "http://example.com/en/8", "http://notexample.com/en/7", "ftp://a.net/de/8", "http://example.net/de/8/9", "http://sub.example.net/de/80", "x://o.org/es/", "x://o.org/es", "x://o.org/ES/", "http://com/en/", "http://user@h.co.uk:80/p", "a://b://c/d", "http://ÀB.com/en/", "http://h.org?x=/es/", "http://h.org#/es/", "http://h\n.org/es/\nq", "://org/es/1"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "page_id long, good int")
    got = {r.page_id: r for r in url_reputation.judge(pages, labels).collect()}
    for i, u in enumerate(URLS):
        host, path = split(u)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, name, verdict or "allow"), u


def test_rules_of_the_driver_table(spark):
    pages = common.table(spark, SF, "pages")
    urls = {r.page_id: r.url for r in pages.collect()}
    labels = common.table(spark, SF, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    for r in url_reputation.judge(pages, labels).collect():
        assert (r.host, r.path) == split(urls[r.page_id])
        assert r.rule == rule(r.host, r.path)[0] and (r.rule is None or r.verdict == rule(r.host, r.path)[1])


def corpus(spark, plan, seed=1):
    """plan: host -> (pages, share of good ones)."""
    rng, pages, labels = random.Random(seed), [], []
    for host, (n, share) in plan.items():
        for i in range(n):
            pages.append((len(pages), f"http://{host}/p{i}", "x"))
            labels.append((len(pages) - 1, int(rng.random() < share)))
    return spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "page_id long, good int")


def test_shrinkage(spark):
    plan = {f"h{i}.good{i % 7}.io": (20, 0.9) for i in range(30)} | {f"h{i}.bad.biz": (20, 0.05) for i in range(30)} | {"new.bad.biz": (1, 1.0), "new.good1.io": (1, 0.0)}
    pages, labels = corpus(spark, plan)
    mean = {r.host: r.a / (r.a + r.b) for r in url_reputation.reputation(pages, labels).collect()}
    assert mean["new.bad.biz"] < 0.5 < mean["new.good1.io"]  # one page doesn't outweigh its neighbours
    assert all(m < 0.4 for h, m in mean.items() if h.endswith("bad.biz")) and all(m > 0.5 for h, m in mean.items() if h.endswith(".io"))
    verdicts = {(r.host, r.verdict) for r in url_reputation.judge(pages, labels).collect()}
    assert ("h3.bad.biz", "block") in verdicts and ("h3.good3.io", "allow") in verdicts


def test_unlabelled_hosts_have_the_prior_of_their_domain(spark):
    plan = {f"h{i}.spam.biz": (20, 0.05) for i in range(30)} | {f"h{i}.fine{i % 7}.io": (20, 0.95) for i in range(30)}
    pages, labels = corpus(spark, plan)
    urls = {-1: "http://new.spam.biz/p", -2: "http://new.other.biz/p", -3: "http://new.fine3.io/p", -4: "http://a.b.org/p", -5: None}
    pages = pages.union(spark.createDataFrame([(k, u, "x") for k, u in urls.items()], pages.schema))
    got = {r.page_id: r for r in url_reputation.judge(pages, labels).collect()}
    assert [got[k].verdict for k in (-1, -2, -3)] == ["block", "block", "allow"]
    rows = {r.host: r for r in url_reputation.reputation(pages, labels).collect()}
    mean = {h: r.a / (r.a + r.b) for h, r in rows.items()}
    known = [r for r in rows.values() if r.n]
    rate = sum(r.good for r in known) / sum(r.n for r in known)
    assert len(known) == 60 and rows["new.spam.biz"].n == 0 and mean["new.spam.biz"] < mean["new.other.biz"] < rate < mean["new.fine3.io"]
    assert abs(mean["a.b.org"] - rate) < 1e-9 and abs(mean[""] - rate) < 1e-9
    # labelled hosts are judged as if the others weren't there
    alone = {r.host: r for r in url_reputation.reputation(pages.filter("page_id >= 0"), labels).collect()}
    assert set(alone) == {r.host for r in known} and all(abs(rows[h].a - r.a) < 1e-9 and abs(rows[h].b - r.b) < 1e-9 for h, r in alone.items())


def test_posterior_equals_plain_arithmetic(spark):
    pages, labels = corpus(spark, {"a.x.com": (30, 0.2), "b.x.com": (10, 0.8), "c.y.com": (40, 0.5), "d.z.net": (5, 1.0)})
    rows = {r.host: r for r in url_reputation.reputation(pages, labels).collect()}
    n = {h: r.n for h, r in rows.items()}
    good = {h: r.good for h, r in rows.items()}
    rate = sum(good.values()) / sum(n.values())

    def strength(level, prior):
        v = {k: prior[k] * (1 - prior[k]) for k in level}
        excess = sum(m * (g / m - prior[k]) ** 2 for k, (m, g) in level.items())
        noise, room = sum(v.values()), sum(level[k][0] * v[k] for k in level)
        if not room or room <= noise or excess <= noise:
            return url_reputation.STRENGTH[1]
        return min(url_reputation.STRENGTH[1], max(url_reputation.STRENGTH[0], (room - noise) / (excess - noise) - 1))

    def up(level, parent):
        out = {}
        for k, (m, g) in level.items():
            a, b = out.get(parent(k), (0, 0))
            out[parent(k)] = (a + m, b + g)
        return out

    hosts = {h: (n[h], good[h]) for h in n}
    domains = up(hosts, lambda h: h.split(".", 1)[1])
    suffixes = up(domains, lambda d: d.split(".")[1])
    post, prior = {}, {s: rate for s in suffixes}
    for level, child, parent in ((suffixes, domains, lambda d: d.split(".")[1]), (domains, hosts, lambda h: h.split(".", 1)[1]), (hosts, None, None)):
        s = strength(level, prior)
        post = {k: (g + s * prior[k], m - g + s * (1 - prior[k])) for k, (m, g) in level.items()}
        if child:
            prior = {k: post[parent(k)][0] / sum(post[parent(k)]) for k in child}
    for h, (a, b) in post.items():
        assert abs(rows[h].a - a) < 1e-9 and abs(rows[h].b - b) < 1e-9


def test_levels(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.com", "com", "", "u@a.x.com:8080", "a.b.co"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: (r.d, r.s) for r in df.select("h", url_reputation.levels(F.col("h"))[0].alias("d"), url_reputation.levels(F.col("h"))[1].alias("s")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.com": ("x.com", "com"), "com": ("com", "com"), "": ("", ""), "u@a.x.com:8080": ("x.com", "com"), "a.b.co": ("b.co", "co")}


def test_awkward_rows(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "http://a.io/x", "x"), (2, "http://a.io/x", "x"), (2, "http://a.io/x", "x")], "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("bound", F.lit("x")).withColumn("good", F.lit(1))
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (2, 7), (2, 1), (2, 0)], "page_id long, good int")
    got = url_reputation.judge(pages, labels)
    assert got.count() == 5 and {r.verdict for r in got.collect()} <= {"allow", "block"}
    assert url_reputation.judge(pages.limit(0), labels).count() == 0


def test_the_method_blocks_hosts_like_those_of_pages(spark):
    """A few bad hosts among many, with the base rate of good pages that real tables have."""
    plan = {f"www{i}.site{i % 11}.example.com": (25, 0.9) for i in range(50)} | {f"m{i}.bad.org": (25, 0.35) for i in range(6)}
    pages, labels = corpus(spark, plan)
    got = {(r.host, r.rule, r.verdict) for r in url_reputation.judge(pages, labels).collect()}
    assert {h for h, rule, v in got if v == "block" and rule is None} == {f"m{i}.bad.org" for i in range(6)}


def test_outcomes_come_from_the_text_a_page_holds(spark):
    words = lambda n, a="w": " ".join(f"{a}{i}" for i in range(n))
    docs = [(1, words(30)), (2, words(16, "x")), (3, words(11, "y")), (4, "  " + words(13, "z").replace(" ", "\n\t")), (5, words(40)), (6, None), (7, words(12, "ü"))]
    pages = [
        (100, f"<html><title>t</title><p class=a><b>{words(20)}</b> more</p></html>"), (2, f"<p>{words(16, 'q')}</p>"), (102, f"<nav>{words(16, 'x')}</nav><article>  {words(12, 'x')} other<br>{words(11)}"),
        (103, f"<p>{words(11, 'y')}</p>"), (104, f"<P>\n{words(13, 'z')}</P>"), (105, f"before {words(16, 'x')}"), (106, None), (107, ""), (108, f"<p>{words(12, 'ü')}"), (109, f"<pre>{words(30)}</pre>"),
    ]
    labels = [(1, 0), (2, 1), (3, 1), (4, 1), (5, None), (6, 1), (7, 0), (7, 1), (None, 1)]
    out = url_reputation.linked_outcomes(spark.createDataFrame(pages, "page_id long, html string"), spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r.page_id: r.good for r in out.collect()} == {100: 0, 102: 1, 104: 1, 108: 1, 109: 0}  # text before the first paragraph counts as one
    empty = spark.createDataFrame([], "page_id long, html string")
    assert url_reputation.linked_outcomes(empty, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_pages_that_share_an_opening_and_copies_of_a_text(spark):
    text = " ".join(f"w{i}" for i in range(20))
    pages = spark.createDataFrame([(i, f"<p>{text} {i}</p>" * 2) for i in range(300)], "page_id long, html string")
    docs = spark.createDataFrame([(i, f"{text} copy {i}") for i in range(50)], "doc_id long, text string")
    for n_good, expected in ((24, 0), (25, 1)):  # the majority of the copies speaks
        labels = spark.createDataFrame([(i, int(i < n_good)) for i in range(50)], "doc_id long, quality int")
        out = url_reputation.linked_outcomes(pages, docs, labels).collect()
        assert len(out) == 300 and {r.good for r in out} == {expected}
