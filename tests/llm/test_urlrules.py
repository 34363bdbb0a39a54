import random
import re
from collections import Counter
from itertools import combinations

from tabweave.llm import queries, urlrules


def urls():
    r = random.Random(4)
    out = [None, "", "no scheme/de/", "http://", "https://EXAMPLE.Org/es/x?y#z", "http://a.example.org/en/12", "http://example.org/en/2", "x://org", "http://com/de/", "http://notcom/de/", "a://b.com/fr", "a://b.com/fr/://c", "http://h\n.com/de/x", "http://u@h.com:80/de/?q"]
    for _ in range(400):
        host = r.choice(["", "www.", "m."]) + r.choice(["a", "bb", "example"]) + "." + r.choice(["com", "org", "net"])
        out.append(f"http://{host}/{r.choice(['de', 'fr', 'en', 'es'])}/{r.randint(1, 99)}" + r.choice(["", "?page=2&ref=x", "#top"]))
    return out


def plain_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    best = None
    for r in queries.URL_RULES:
        h, _, p = r.text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return best


def test_parts_and_explicit_rules(spark):
    rows = [(i, u, "verdict") for i, u in enumerate(urls())]
    out = {r.page_id: r for r in urlrules.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string"), queries.URL_RULES).collect()}
    assert len(out) == len(rows)
    for i, u, _ in rows:
        host, path = plain_parts(u)
        rule = plain_rule(host, path)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule and rule.text), u
        assert out[i].verdict == rule.verdict if rule else out[i].verdict in ("allow", "block")
    assert urlrules.judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(9)
    data = []
    for _ in range(300):
        t = sorted(set(r.choices(["a", "b", "c", "d", "e"], k=r.randint(1, 4))))
        data.append((t, "block" if {"a", "b"} <= set(t) or r.random() < 0.05 else "allow"))
    df = spark.createDataFrame(data, "tokens array<string>, label string")
    support, confidence, count = 0.05, 0.6, 5
    rules = []
    names = sorted({x for t, _ in data for x in t})
    for k in range(1, 4):
        for combo in combinations(names, k):
            own = [label for t, label in data if set(combo) <= set(t)]
            for label, n in Counter(own).items():
                if n >= max(support * len(data), count) and urlrules.wilson(n, len(own)) >= confidence:
                    rules.append(urlrules.MinedRule(combo, label, urlrules.wilson(n, len(own)), n / len(data)))
    want = [r for r in rules if not any(k.verdict == r.verdict and k.limit >= r.limit and set(k.tokens) < set(r.tokens) for k in rules)]
    got = urlrules.mine(df, support, confidence, count)
    key = lambda r: (r.tokens, r.verdict, round(r.limit, 9), round(r.support, 9))
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert ("a", "b") in {r.tokens for r in got if r.verdict == "block"}
    # the index finds what testing all rules finds
    out = df.select("tokens", urlrules.matched(got, "tokens").alias("v")).collect()
    for row in out:
        fit = [r for r in got if set(r.tokens) <= set(row.tokens)]
        best = max(fit, key=lambda r: (r.limit, r.support, -len(r.tokens), r.verdict, r.tokens), default=None)
        assert row.v == (best and best.verdict)


def test_many_common_tokens_are_bounded(spark):
    r = random.Random(2)
    shared = [f"s{k}" for k in range(30)]
    rows = [([*shared, f"x{i % 5}"], "block" if i % 5 == 0 else "allow") for i in range(200)]  # 30 segments that all have
    rows += [(sorted(r.sample(shared, 15)), "allow") for _ in range(100)]  # and 30 that come and go
    got = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"))
    assert ("x0",) in {g.tokens for g in got if g.verdict == "block"} and len(got) < 29_800
    assert all(len(g.tokens) <= urlrules.LENGTH for g in got)


def test_held_out_urls(spark):
    r = random.Random(6)
    make = lambda: (f"http://{r.choice('abc')}{r.randint(1, 9)}.net/{(k := r.choice(['ads', 'news', 'shop', 'track']))}/{r.randint(1, 999)}?x={r.randint(1, 9)}", "block" if k in ("ads", "track") else "allow")
    known, new = [make() for _ in range(400)], [make() for _ in range(200)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(new)], "page_id long, url string")
    out = {x.page_id: x.verdict for x in urlrules.judge(pages, [], labels=spark.createDataFrame(known, "url string, label string")).collect()}
    assert sum(out[i] == v for i, (_, v) in enumerate(new)) >= 0.95 * len(new)


def test_columns_of_any_name_and_long_urls(spark):
    rows = [(1, "http://x.org/" + "a/" * 50_000, "h", "p", "r", "v", "t", "f"), (2, None, "h", "p", "r", "v", "t", "f")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule_ string, rule string, tokens string, c0 string")
    out = urlrules.judge(df, queries.URL_RULES)
    assert out.columns == ["page_id", "url", "host_", "path_", "rule_", "rule__", "tokens", "c0", "host", "path", "rule", "verdict"]
    got = {x.page_id: x for x in out.collect()}
    assert got[1].rule == "org/" and got[1]["host_"] == "h" and got[1]["rule__"] == "v" and got[2].verdict == "allow" and got[2].host == ""


def test_labels_given_and_none(spark):
    pages = spark.createDataFrame([(1, "http://x.net/ads/1"), (2, "http://x.net/news/1")], "page_id long, url string")
    labels = spark.createDataFrame([(f"http://h{i}.net/{'ads' if i % 2 else 'news'}/{i}", "block" if i % 2 else "allow") for i in range(100)], "url string, label string")
    assert {r.page_id: r.verdict for r in urlrules.judge(pages, [], labels=labels).collect()} == {1: "block", 2: "allow"}
    assert {r.verdict for r in urlrules.judge(pages, []).collect()} == {"allow"}
