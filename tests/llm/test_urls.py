from itertools import combinations

from tests.oracle import SF_DIR

from sourcelens.llm import urls

URLS = [
    "http://www.Example.COM/en/1", "http://a.www.example.com/en/2?x=/fr/", "https://example.com/en/9", "https://b.example.com/en", "x://example.com", "http://s.net/es/1",
    "http://net/fr/", "http://internet/fr/1", "nothing", None, "", "a://b://c.com/x#y?z", "http://shop.org/es/77.html?page=1&ref=b#top", "http://t.net/de/1", "http://q.com?x",
]


def brute_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[n:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), tail[:end]


def brute_rule(u):
    h, p = brute_parts(u)
    fit = [r for r in urls.RULES if (h == r[1] or h.endswith("." + r[1])) and p.startswith(r[2])]
    return max(fit, key=lambda r: len(r[1] + r[2]), default=None)


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(None, URLS[0], "h", "v"), (0, URLS[0], "h", "v")], "page_id long, url string, html string, verdict string")
    got = urls.url_filter(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        u = URLS[r.page_id or 0]
        rule = brute_rule(u)
        assert (r.host, r.path) == brute_parts(u)
        assert r.rule == (rule[1] + rule[2] if rule else None)
        assert r.verdict in ("allow", "block") and (not rule or r.verdict == rule[0])
    assert urls.url_filter(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.url_filter(pages.where("url is null or url = 'nothing'")).collect()} == {"allow"}


def brute_best(tokens, labelled, support, confidence, verdicts=("allow", "block")):
    """The highest confidence of a rule for a set of tokens, from all combinations."""
    best, need = None, support * len(labelled)
    for k in range(1, urls.MOST_TOKENS + 1):
        for a in combinations(sorted(tokens), k):
            hits = [v for t, v in labelled if set(a) <= t]
            for v in verdicts:
                n = hits.count(v)
                if n and n >= need and n / len(hits) >= confidence:
                    best = max(best or 0, n / len(hits))
    return best


def test_mined_rules_brute_force(spark):
    """On real URLs, every mined verdict is that of a rule with the highest confidence."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r for r in urls.url_filter(pages, min_support=0.02).collect()}
    rows = pages.select("page_id", "url", urls.tokens(urls.F.col("url")).alias("t")).collect()
    assert len(got) == len(rows)
    labelled = [(set(r.t), brute_rule(r.url)[0]) for r in {r.url: r for r in rows}.values() if brute_rule(r.url)]
    n = 0
    for r in rows:
        if brute_rule(r.url) is None:
            want, g = brute_best(r.t, labelled, 0.02, urls.MIN_CONFIDENCE), got[r.page_id]
            if want is None:
                assert g.confidence is None and g.verdict == urls.DEFAULT
            else:
                n += 1
                assert abs(g.confidence - want) < 1e-9
                assert abs(brute_best(r.t, labelled, 0.02, urls.MIN_CONFIDENCE, (g.verdict,)) - want) < 1e-9
    assert n > 0


def test_rules_of_every_length(spark):
    """Four tokens together imply a verdict that no three of them do."""
    four = ["a", "b", "c", "d"]
    rows = [(four, "block")] * 4 + [(list(t), "allow") for t in combinations(four, 3)] * 2
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8)
    want = set()
    for k in range(1, 5):
        for t in combinations(four, k):
            hits = [v for x, v in rows if set(t) <= set(x)]
            want |= {(t, v) for v in ("allow", "block") if hits.count(v) >= 0.8 * len(hits)}
    assert {(tuple(r.antecedent), r.verdict) for r in rules.collect()} == want == {(tuple(four), "block")}
    got = urls.match(spark.createDataFrame([("u", [*four, "e"]), ("v", four[:3])], "url string, tokens array<string>"), rules).collect()
    assert [(r.url, r.mined, r.confidence) for r in got] == [("u", "block", 1.0)]
