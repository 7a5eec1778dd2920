"""The tree of path templates against a plain recursion over dictionaries."""

import math
import random
import re
from collections import defaultdict

import pytest

from skein.llm.url_filter import RULES, judge_urls
from tests.conftest import SMALL

LEVELS, MANY, K, Z, LEAST = 4, 12, 2.0, 1.96, 5


def parse(url):
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
    return host, path, max(fit, key=lambda r: len(r[0] + r[1]))[2] if fit else None


def plain_tree(urls):
    """(template, purity) by (host, path)."""
    stats = defaultdict(lambda: [0, 0])
    for url in urls:
        host, path, ruled = parse(url)
        cell = stats[host, path]
        cell[0] += ruled is not None
        cell[1] += ruled == "block"
    n, bad = (sum(c[k] for c in stats.values()) for k in (0, 1))
    base = bad / (n + K)
    at = {}
    for host, path in stats:
        own = [c for (h, _), c in stats.items() if h == host]
        at[host, path] = ("", (sum(c[1] for c in own) + K * base) / (sum(c[0] for c in own) + K))
    pieces = {k: (k[1][1:] if k[1].startswith("/") else k[1]).split("/") if k[1] else [] for k in stats}
    for level in range(LEVELS):
        nodes = defaultdict(lambda: defaultdict(list))
        for key, parts in pieces.items():
            if len(parts) > level:
                nodes[key[0], at[key][0]][parts[level]].append(key)
        named = {}
        for node, kinds in nodes.items():
            paths = sum(map(len, kinds.values()))
            named[node] = defaultdict(list)
            for segment, keys in kinds.items():
                rare = len(kinds) > MANY and len(keys) * len(kinds) < paths
                variable = re.fullmatch("[0-9]+", segment) or len(segment) >= 32 or rare
                named[node]["*" if variable else segment] += keys
        across = defaultdict(lambda: [0, 0])
        for (_, template), names in named.items():
            for name, keys in names.items():
                for key in keys:
                    across[template, name][0] += stats[key][0]
                    across[template, name][1] += stats[key][1]
        for node, names in named.items():
            seen, evidence = {}, {}
            for name, keys in names.items():
                xn, xb = across[node[1], name]
                n, bad = (sum(stats[k][i] for k in keys) for i in (0, 1))
                seen[name] = (bad + K * (xb + K * base) / (xn + K), n + K)
                evidence[name] = (bad, n) if n >= LEAST else (xb, xn) if xn >= LEAST else (0, 0)
            se, sm = (sum(v[k] for v in evidence.values()) for k in (0, 1))
            alike = []
            for name, (e, m) in evidence.items():
                oe, om = se - e, sm - m
                if m and om >= LEAST:
                    p = se / sm
                    if round(abs(e / m - oe / om), 9) <= round(Z * math.sqrt(max(p * (1 - p), 0) * (1 / m + 1 / om)), 9):
                        alike.append(name)
            alike = alike if len(alike) > 1 else []
            groups = defaultdict(list)
            for name in names:
                groups["+" if name in alike else name].append(name)
            for to, members in groups.items():
                e, m = (sum(seen[x][k] for x in members) for k in (0, 1))
                for key in [k for x in members for k in names[x]]:
                    at[key] = (f"{node[1]}/{to}", (e + K * at[key][1]) / (m + K))
    return {k: (t + ("/**" if len(pieces[k]) > LEVELS else ""), p) for k, (t, p) in at.items()}


def made_urls():
    rng = random.Random(5)
    hosts = ["a.com", "b.com", "x.org", "n.net", "example.org", "m.net"]
    urls = []
    for _ in range(1500):
        parts = [rng.choice(["de", "fr", "en", "es"]), rng.choice(["news", "shop", f"p{rng.randrange(60)}"]), str(rng.randrange(99)), "x", "y", "z"]
        urls.append(f"http://{rng.choice(hosts)}/" + "/".join(parts[: rng.randrange(0, 7)]))
    return [*urls, None, "", "none", "http://a.com", "http://a.com//", "http://N.net/de/" + "q" * 40]


@pytest.mark.parametrize("source", ["pages", "made"])
def test_the_tree_equals_plain_recursion(spark, source):
    urls = made_urls() if source == "made" else [p.url for p in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    want = plain_tree(urls)
    got = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, ruled = parse(urls[r.page_id])
        template, purity = want[host, path]
        assert (r.host, r.path, r.template) == (host, path, template)
        assert abs(r.purity - purity) < 2e-6
        assert r.verdict == (ruled or ("block" if purity > 0.5 else "allow"))
    if source == "made":
        assert any("*" in r.template for r in got) and any("+" in r.template for r in got)
        assert len({r.verdict for r in got if r.rule is None}) == 2


def test_without_labels_all_is_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {(r.verdict, r.purity) for r in judge_urls(pages).collect()} == {("allow", 0.0)}


def verdicts(spark, urls):
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    return {urls[r.page_id]: r for r in rows}


def test_a_host_without_labels_judges_by_what_its_branches_are_elsewhere(spark):
    """By outcome: sections that rules block elsewhere are blocked, those that they allow allowed."""
    labelled = [f"http://h.com/{lang}/{kind}/{i}" for lang in ("de", "fr") for kind in ("news", "shop") for i in range(40)]
    asked = [f"http://u.net/{lang}/{kind}/{i}" for lang in ("de", "fr") for kind in ("news", "blog") for i in range(20)]
    found = verdicts(spark, [*labelled, *asked])
    for url in asked:
        assert found[url].verdict == ("block" if "/de/" in url else "allow"), (url, found[url])
    templates = {lang: {found[u].template.split("/")[1] for u in asked if f"/{lang}/" in u} for lang in ("de", "fr")}
    assert templates == {"de": {"de"}, "fr": {"fr"}}


def test_branches_known_to_be_alike_are_merged_and_unknown_ones_are_not(spark):
    labelled = [f"http://h.com/{lang}/{kind}/{i}" for lang in ("de", "fr") for kind in ("news", "shop") for i in range(40)]
    found = verdicts(spark, [*labelled, *(f"http://u.net/{x}/a/{i}" for x in ("new", "other") for i in range(30))])
    assert {r.template.split("/")[1] for u, r in found.items() if "u.net" in u} == {"new", "other"}
    assert {r.template.split("/")[2] for u, r in found.items() if "h.com/de" in u} == {"+"}


def test_a_host_with_labels_of_its_own_goes_by_them(spark):
    """The language is blocked everywhere but on one host, whose own rule allows it."""
    rules = (("com", "/de/", "block"), ("good.com", "/de/news/", "allow"), ("com", "/fr/", "allow"))
    urls = [f"http://h{k}.com/{lang}/x/{i}" for k in range(4) for lang in ("de", "fr") for i in range(20)]
    urls += [f"http://good.com/de/news/{i}" for i in range(40)]
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    assert {r.verdict for r in rows if r.host == "good.com"} == {"allow"}
    assert max(r.purity for r in rows if r.host == "good.com") < 0.5
