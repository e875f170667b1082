import random

from pyspark.sql import functions as F
from rows import clashing

from evalspark.llm import urls


def by_hand(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def judged(spark, pages, rules):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = urls.judge(clashing(df), urls.rule_table(spark, rules)).collect()
    assert len(got) == len(pages)
    return sorted(tuple(r[c] if r[c] is not None else None for c in ("page_id", "host", "path", "rule", "verdict")) for r in got)


def test_given_rules(spark):
    pages = ["https://tionsh.example.net/en/1", "http://EXAMPLE.net/en", "http://example.net/en/?q", "http://a.net", "http://a.net?x/en/", "http://net/",
             "https://x.example.com/de/9#top", "https://x.example.com/en/", "http://b.org/fr/", "http://borg/fr/", "http://notexample.com/de/", None, "", "mailto:x",
             "://net/x", "http://é.ORG/fr/é?ü", "http://a.b.net:80/", "http://net./", "http://.net/", "a://b://c.net/", "http://\nnet/x\ny"]
    rows = [(i, u, "h") for i, u in enumerate(pages)]
    assert judged(spark, rows, urls.RULES) == sorted((i, *by_hand(u, urls.RULES)) for i, u, _ in rows)


def test_random_nested_rules(spark):
    rng = random.Random(4)
    host = lambda: ".".join(rng.choices(["a", "b", "ab", "com"], k=rng.randrange(1, 5)))
    path = lambda: rng.choice(["", "/", "/a", "/a/", "/a/b", "/ab", "/é", "/a/b/c"])
    rules = [(host(), path(), rng.choice(["block", "allow"])) for _ in range(80)] + [("a", "/", "allow"), ("a", "/", "block"), ("", "/", "block")]
    pages = [(i, f"http://{host()}{path()}{rng.choice(['', 'x', '?q', '#t'])}", None) for i in range(400)]
    pages += [(1000 + i, "http://hot.a.com/a/b", None) for i in range(200)] + [pages[0]]
    # of equally long rules the longer host wins; the same string from two splits has one name
    assert judged(spark, pages, rules) == sorted((i, *by_hand(u, rules)) for i, u, _ in pages)


def test_empty_tables_and_no_python(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge(none, urls.rule_table(spark)).count() == 0
    some = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    out = urls.judge(some, urls.rule_table(spark).filter(F.lit(False)))
    assert [tuple(r) for r in out.collect()] == [(1, "a.net", "/", None, "allow")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_parent_key_is_swept_once(spark, monkeypatch):
    """All hosts of a domain with one path share their parents' keys."""
    seen, keep = {}, urls.materialize
    monkeypatch.setattr(urls, "materialize", lambda df, name: seen.setdefault(name, keep(df, name)))
    rules = [("net", "/", "block"), ("h7.net", "/", "allow")]
    pages = [(i, f"http://h{i % 100}.net/", None) for i in range(300)]
    assert judged(spark, pages, rules) == sorted((i, *by_hand(u, rules)) for i, u, _ in pages)
    swept = [r["at"]["key"] for r in seen["url-keys"].filter("at.kind = 2").collect()]
    assert len(swept) == len(set(swept)) == 101
