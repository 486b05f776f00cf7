import re

from tickerlake.llm import op8_url_filters as op

PAGES = "page_id long, url string, host string, verdict int"
SHOWN = ("page_id", "host", "path", "rule", "verdict")


def judged(spark, urls, outcomes=()):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], PAGES)
    rows = op.judge(pages, spark.createDataFrame(list(outcomes), "page_id long, bad boolean")).orderBy("page_id").collect()
    return [tuple(r[c] for c in SHOWN) for r in rows]


def test_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://notexample.com/en/", "a://b://c/d", "http://x.net/es/1", "http://x.net?/es/", "http://net/fr/", "http://É.COM/É#", "ftp://com", "http://sub.www.example.com/en/\nq"]
    got = judged(spark, urls)
    for (i, host, path, rule, verdict), url in zip(got, urls, strict=True):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
        want = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in op.RULES if (want[0] == h or want[0].endswith("." + h)) and want[1].startswith(p)]
        assert (host, path) == want
        assert rule == (max(fits)[1] if fits else None)
        assert verdict == (max(fits)[2] if fits else "allow")


def test_reputation(spark):
    urls = [f"http://bad.x.org/{i}" for i in range(60)] + [f"http://good.x.org/{i}" for i in range(60)] + ["http://new.x.org/", "http://bad.x.org/more", "http://rare.x.org/"]
    outcomes = [(i, i < 60) for i in range(120)] + [(0, None), (None, True), (122, True)]
    got = judged(spark, urls, outcomes)
    assert {r[4] for r in got if r[1] == "bad.x.org"} == {"block"}
    assert {r[4] for r in got if r[1] == "good.x.org"} == {"allow"}
    assert [r[4] for r in got if r[1] in ("new.x.org", "rare.x.org")] == ["allow", "allow"]


def test_empty_and_repeated(spark):
    assert judged(spark, []) == []
    pages = spark.createDataFrame([(1, "http://a.b/", "x", 1)] * 2, PAGES)
    rows = op.judge(pages, spark.createDataFrame([(1, False), (1, None)], "page_id long, bad boolean")).collect()
    assert len(rows) == 2 and {r.verdict for r in rows} == {"allow"}
