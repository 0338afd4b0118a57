"""URL verdicts against a plain model, posterior bounds against numeric quantiles."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nodeflow.llm import urlfilter
from nodeflow.llm.urlfilter import Rule, UrlParams, beta_quantile, domain_and_suffix, judge, reputations

RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("allow", "example.org", "/es/ok"), Rule("block", "com", "/de/")]
PAGES = "page_id long, url string, html string, rows int, found string, host string, verdict string, n int, k int, m double, bad boolean, rule string, _salt int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "f", "h", "v", 1, 1, 0.5, True, "r", 3) for r in rows], PAGES)


def outcomes(spark, rows):
    return spark.createDataFrame(rows, "page_id long, bad boolean")


def _rule(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in found[1]), found[2]) if found else ("", "")
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best


def test_rules_and_parts(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://A.Example.ORG/es/x?y#z", "http://example.org/es/ok/1", "http://example.org", "http://myexample.org/es/",
            "https://b.com/de/1", "https://b.com/dex", "http://u@c.com:80/de/?q=://x.org/", "x http://q.org/a\nb", "http://com/de/", "http://É.org/É"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(None, urls[5]), (3, urls[5]), (3, urls[5])]
    got = judge(pages(spark, rows), outcomes(spark, []), RULES).collect()
    want = sorted((k if k is not None else -1, *(_rule(u)[:2]), (lambda r: r and r.host + r.path)(_rule(u)[2])) for k, u in rows)
    assert sorted((r["page_id"] if r["page_id"] is not None else -1, r["host"], r["path"], r["rule"]) for r in got) == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3] or ""))
    assert {r["verdict"] for r in got} == {"allow", "block"} and all(r["verdict"] == "allow" for r in got if r["rule"] is None)
    assert judge(pages(spark, []), outcomes(spark, []), RULES).count() == 0


def test_domains(spark):
    names = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "a.x.co.uk:8080": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "localhost": ("localhost", "localhost"), "": ("", ""), "u:p@a.b.c.": ("b.c", "c"), "10.0.0.1:80": ("10.0.0.1", "ip")}
    d, s = domain_and_suffix(F.col("host"), ("co.uk",))
    got = spark.createDataFrame([(n,) for n in names], "host string").select("host", d.alias("d"), s.alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in got} == names


@pytest.mark.parametrize("p", [0.05, 0.95])
def test_quantile(spark, p):
    pairs = [(a, b) for a in (0.3, 0.8, 1.0, 1.5, 4, 30, 2000) for b in (0.4, 1.0, 2.5, 4, 12, 500)]
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    for r in rows.select("a", "b", beta_quantile(F.col("a"), F.col("b"), p).alias("x")).collect():
        u = (np.arange(200_000) + 0.5) / 200_000
        both = np.log(u**4 + (1 - u) ** 4)  # x = u^4 / (u^4 + (1 - u)^4): finer at both ends
        log_x, log_y = 4 * np.log(u) - both, 4 * np.log1p(-u) - both
        x, log = np.exp(log_x), r["a"] * log_x + r["b"] * log_y - np.log(u * (1 - u))
        w = np.exp(log - log.max())
        assert abs(x[np.searchsorted(np.cumsum(w) / w.sum(), p)] - r["x"]) < (0.01 if min(r["a"], r["b"]) >= 4 else 0.085), r


def _model(rows, labels, params=UrlParams()):
    """Posterior of every host by plain loops."""
    bad = {}
    for i, b in labels:
        if i is not None:
            bad[i] = bad.get(i, False) or bool(b)
    hosts = {}
    for i, u in rows:
        h = hosts.setdefault(_rule(u)[0], [0, 0])
        if i in bad:
            h[0] += 1
            h[1] += bad[i]
    total = [sum(x) for x in zip(*hosts.values())]

    def shrink(nodes, mean):
        some = {c: x for c, x in nodes.items() if x[0] > 1}
        over = sum((k - n * mean[c]) ** 2 - n * mean[c] * (1 - mean[c]) for c, (n, k) in some.items())
        scale = sum(n * (n - 1) * mean[c] * (1 - mean[c]) for c, (n, _) in some.items())
        s = 1 / min(0.5, max(1e-3, over / scale if scale else 1e-3)) - 1
        return {c: (s * mean[c] + k) / (s + n) for c, (n, k) in nodes.items()}, s

    def up(level, parent):
        out = {}
        for c, (n, k) in level.items():
            x = out.setdefault(parent(c), [0, 0])
            x[0] += n
            x[1] += k
        return out

    domain, suffix = (lambda h: ".".join(h.split(".")[-2:])), (lambda h: h.split(".")[-1])
    domains = up(hosts, domain)
    suffixes = up(domains, suffix)
    means, _ = shrink(suffixes, {c: (total[1] + 0.5) / (total[0] + 1) for c in suffixes})
    means, _ = shrink(domains, {c: means[suffix(c)] for c in domains})
    means, s = shrink(hosts, {c: means[domain(c)] for c in hosts})
    return {h: (n, k, means[h]) for h, (n, k) in hosts.items()}


def test_reputation_equals_model(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rate = {f"h{k}.d{k % 7}.{'abc'[k % 3]}": (0.95 if k % 9 == 0 else 0.1) for k in range(60)}
    names = list(rate)
    rows = [(i, f"http://{names[int(rng.integers(60)) if i % 3 else 0]}/p") for i in range(4000)] + [(9000, "http://new.d1.b/"), (9001, None)]
    labels = [(i, bool(rng.random() < rate[_rule(u)[0]])) for i, u in rows[:4000] if i % 2] + [(1, True), (None, True), (5, None), (123456, True)]
    got = {}
    for hot in (1000, 2):  # the second way joins nearly all hosts by key
        look = urlfilter.look_up
        monkeypatch.setattr(urlfilter, "look_up", lambda *a: look(*a, hot=hot))
        table = reputations(pages(spark, rows).select("page_id", urlfilter.host_and_path(F.col("url"))[0].alias("host")), outcomes(spark, labels))
        got[hot] = {r["host"]: (r["n"], r["k"], round(r["mean"], 9)) for r in table.collect()}
        monkeypatch.undo()
    assert got[1000] == got[2] == {h: (n, k, round(m, 9)) for h, (n, k, m) in _model(rows, labels).items()}
    verdicts = {r["host"]: r["verdict"] for r in judge(pages(spark, rows), outcomes(spark, labels)).collect()}
    assert all((verdicts[h] == "block") == (rate[h] > 0.5) for h in names if got[2][h][0] >= 25)
    assert verdicts["new.d1.b"] == "allow" and len(judge(pages(spark, rows), outcomes(spark, labels)).collect()) == len(rows)


def test_few_bad_labels_do_not_block(spark):
    rows = [(i, f"http://{'good' if i else 'once'}.site.net/") for i in range(50)]
    assert {r["verdict"] for r in judge(pages(spark, rows), outcomes(spark, [(i, i == 0) for i in range(50)])).collect()} == {"allow"}


def test_no_python_in_the_plan(spark, sf):
    from nodeflow.llm.queries import QUERIES

    plan = QUERIES["op13_url_filters"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
