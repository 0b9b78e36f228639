import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import queries, url_templates
from ledgerloom.session import load

RULES = queries.URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def form(segment):
    if len(segment) > 64:
        return "{long}"
    keyless = re.sub(r"(?<![0-9A-Za-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?![0-9A-Za-z])", "{x}", segment)
    return re.sub("[0-9]+", "{n}", keyless)


def follows(segments, at):
    if at >= len(segments):
        return 0
    s = segments[at]
    return 1 if s == "{n}" else 2 if "{n}" in s else 3 if "{x}" in s or s == "{long}" else 4 if re.search("[-_.]", s) else 5


def brute(urls, depth=8, most=20, smoothing=4.0, least=0.3):
    """The tree by recursion over lists of urls, host by host."""
    found = [None] * len(urls)
    split = [parts(u) for u in urls]
    rules = [rule(*s) for s in split]
    segments = [[form(x) for x in p.split("/") if x][:depth] for _, p in split]
    good, bad = sum(v == "allow" for _, v in rules), sum(v == "block" for _, v in rules)

    def grow(node, rows, level, above):
        g, b = sum(rules[k][1] == "allow" for k in rows), sum(rules[k][1] == "block" for k in rows)
        purity = (g + smoothing * above) / (g + b + smoothing)
        for k in rows:
            if len(segments[k]) < level:
                found[k] = (node, purity, g + b)
        rows = [k for k in rows if len(segments[k]) >= level]
        kids = defaultdict(list)
        for k in rows:
            kids[segments[k][level] if level < len(segments[k]) else ""].append(k)
        different = len(set(kids) - {""})
        if different > most or len(rows) >= 10 and different * 2 > len(rows):
            names = {c: "{*}" if c else "" for c in kids}
        else:
            names = url_templates.merge_children([
                {"child": c, "n": len(of), "good": sum(rules[k][1] == "allow" for k in of), "bad": sum(rules[k][1] == "block" for k in of),
                 "next": [Counter(follows(segments[k], level + 1) for k in of)[x] for x in range(url_templates.CLASSES)]} for c, of in kids.items()], 0.1)
        merged = defaultdict(list)
        for c, of in kids.items():
            merged[names[c]] += of
        for name, of in merged.items():
            grow(f"{node}/{name}", of, level + 1, purity)

    hosts = defaultdict(list)
    for k, (host, _) in enumerate(split):
        hosts[host].append(k)
    for host, rows in hosts.items():
        grow(host, rows, 0, (good + smoothing * 0.5) / (good + bad + smoothing))
    return [(h, p, r, v or ("block" if f[1] < least else "allow"), f[0], f[2]) for (h, p), (r, v), f in zip(split, rules, found)], [f[1] for f in found]


def check(spark, urls):
    got = sorted(url_templates.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect())
    want, purity = brute(urls)
    assert [(r.host, r.path, r.rule, r.verdict, r.template, r.labelled) for r in got] == want
    assert [r.purity for r in got] == pytest.approx(purity)
    return got


def test_equals_recursion_on_pages(spark):
    got = check(spark, [r.url for r in load(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").collect()])
    assert {r.rule for r in got} >= {"org/", "com/fr/", "com/de/", "example.org/es/", "example.org/en/1", None}


def test_equals_recursion_on_made_urls(spark):
    rng = random.Random(3)
    hosts = ["a.com", "B.A.com", "x.org", "example.org", "sub.example.org", "notexample.org", "shop.net", "com", "example.org:80"]
    words = ["de", "fr", "en", "es", "1", "42", "tag", "user-7", "p_2.html", "deadbeef01", "2024-01-02", "q" * 70, "é", ""]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}" + "".join("/" + rng.choice(words) for _ in range(rng.randrange(6))) + rng.choice(["", "?a=/b", "#c", "/", "?x#y"]) for _ in range(600)]
    urls += [f"http://wide.net/{w}/post" for w in ("slug-" + "".join(rng.choice("abcdef") for _ in range(6)) for _ in range(60))]
    urls += [None, "", "no scheme", "://", "http://", "http://?", "http:///p", "a://b://c/d", "HTTP://UPPER.ORG/Path", "http://h.org", "http://ÉT.org/", "http://deep.net" + "/a" * 5000, "http://n.net/a\nb/c"]
    check(spark, urls + urls[:50])


def test_labelled_purity_rejects_and_spreads_to_like_branches(spark):
    blocked = [f"http://bad.com/de/{k}.html" for k in range(40)] + [f"http://bad.com/xx/{k}.html" for k in range(20)]
    mixed = [f"http://mix.com/{lang}/{k}" for lang in ("de", "fr", "en") for k in range(40)]
    got = {r.path + "@" + r.host: r for r in check(spark, blocked + mixed + [f"http://free.net/{k}" for k in range(5)])}
    assert got["/xx/3.html@bad.com"].verdict == "block" and got["/xx/3.html@bad.com"].rule is None  # like the branch that a rule blocks
    assert got["/en/3@mix.com"].verdict == "allow" and got["/en/3@mix.com"].template == "mix.com/en/{n}/"  # resembles both, joins neither
    assert got["/3@free.net"].verdict == "allow" and got["/3@free.net"].labelled == 0


def test_merging_needs_like_followers_and_labels():
    def c(child, n, good=0, bad=0, **follow):
        return {"child": child, "n": n, "good": good, "bad": bad, "next": [follow.get(f"c{k}", 0) for k in range(6)]}

    merge = lambda *kids: url_templates.merge_children(list(kids), 0.1)
    assert merge(c("a", 50, c1=50), c("b", 40, c1=40), c("z", 60, c5=60)) == {"a": "{a|b}", "b": "{a|b}", "z": "z"}
    assert merge(c("a", 50, 50, c1=50), c("b", 40, 0, 40, c1=40)) == {"a": "a", "b": "b"}
    assert merge(c("a", 50, 50, c1=50), c("b", 40, 0, 40, c1=40), c("u", 9, c1=9)) == {"a": "a", "b": "b", "u": "u"}
    assert merge(c("a", 50, 50, c1=50), c("u", 9, c1=9), c("", 3, c0=3)) == {"a": "{a|u}", "u": "{a|u}", "": ""}
    assert url_templates.alike([500_000, 500_000], [509_000, 491_000], 0.1) and not url_templates.alike([500, 500], [800, 200], 0.1)


def test_empty_table_repeats_nulls_and_clashing_columns(spark):
    assert url_templates.judge(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []
    rows = [(1, "http://a.com/de/1", "x", 1.0, "y"), (1, "http://a.com/de/1", "x", 1.0, "y"), (None, "http://a.com/fr/1", None, None, None), (2, None, None, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, purity double, key string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_templates.judge(table, RULES).collect()), key=repr)
    assert got == sorted([(1, "a.com", "/de/1", "com/de/", "block")] * 2 + [(None, "a.com", "/fr/1", "com/fr/", "allow"), (2, "", "", None, "allow")], key=repr)
    assert {(r.purity, r.verdict) for r in url_templates.judge(table, []).collect()} == {(0.5, "allow")}
