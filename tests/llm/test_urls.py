import math
import random
import re
from collections import defaultdict

import pytest

from sellerlens.llm import urls
from sellerlens.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host string, path string, n string, template string"


def frame(spark, given):
    return spark.createDataFrame([(i, u, None, "h", "p", "n", "t") for i, u in enumerate(given)], SCHEMA)


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
    path = rest[k:]
    return host, path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]


GIVEN = ["http://A.Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2", "https://x.com/fr/a?b=/de/",
         "https://x.com/de/", "https://x.com/de", "http://xcom/fr/", "http://org", "http://org/", "http://y.net/en/1#/x",
         None, "", "no scheme", "a://b://c/d", "http://ÄB.com/fr/\n", "http://x.com/fr/" + "a/" * 5000, "https://x.com/de/", "//x.com/fr/"]


def test_parsing_and_rules(spark):
    out = {r.page_id: r for r in urls.judge(frame(spark, GIVEN), URL_RULES).collect()}
    assert len(out) == len(GIVEN)
    for i, u in enumerate(GIVEN):
        host, path = brute(u)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, best and best.text)
        assert out[i].verdict == best.verdict if best else out[i].verdict in ("allow", "block")


def test_templates_reject_by_labelled_purity(spark):
    given = [f"http://s.net/spam/{i}" for i in range(40)] + [f"http://s.net/news/{i}.html" for i in range(40)]
    pages = frame(spark, given)
    labels = spark.createDataFrame([(i, int(i < 20)) for i in [*range(20), *range(40, 60)]], "page_id long, bad int")
    out = {r.page_id: r for r in urls.judge(pages, [], labels).collect()}
    assert {out[i].verdict for i in range(40)} == {"block"} and {out[i].template for i in range(40)} == {"/spam/*"}
    assert {out[i].verdict for i in range(40, 80)} == {"allow"}


def test_many_children_become_a_wildcard(spark):
    out = urls.judge(frame(spark, [f"http://s.net/user/{chr(97 + i % 26)}{chr(97 + i // 26)}x/home" for i in range(60)]), [])
    assert {r.template for r in out.collect()} == {"/user/*/home"}


def test_empty(spark):
    assert urls.judge(frame(spark, []), URL_RULES).count() == 0


def test_differing_sections_survive_many_children_and_depth(spark):
    sections = [f"s{chr(97 + i)}x" for i in range(26)]
    given = [f"http://s.net/{s}/{i}" for s in sections for i in range(20)]
    deep = "/".join(f"d{chr(97 + i)}x" for i in range(15))
    given += [f"http://t.net/{deep}/{s}/{i}" for s in ("good", "bad") for i in range(20)]
    bad = [int("/sax/" in u or "/bad/" in u) for u in given]
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad) if i % 2], "page_id long, bad int")
    out = {r.page_id: r.verdict for r in urls.judge(frame(spark, given), [], labels).collect()}
    assert [out[i] == "block" for i in range(len(given))] == [bool(b) for b in bad]


def brute_templates(given, bad, p):
    """Template and purity of every url by plain loops over the same rounds."""
    at = [brute(u) for u in given]
    shapes = [["*" if re.search(urls.VARIABLE, s) else s for s in path.split("/") if s] for _, path in at]
    names = [list(s) for s in shapes]
    for _ in range(p.rounds):
        kids = defaultdict(lambda: [0, 0])
        for (host, _), shape, name, b in zip(at, shapes, names, bad):
            for d, seg in enumerate(shape):
                k = kids[(host, tuple(name[:d])), seg]
                k[0] += b is not None
                k[1] += b or 0
        nodes = defaultdict(list)
        for (node, seg), k in kids.items():
            nodes[node].append(k)

        def rename(node, seg):
            all_l, all_b = (sum(k[i] for k in nodes[node]) for i in (0, 1))
            n, b = kids[node, seg]
            rate = all_b / max(all_l, 1)
            spread = math.sqrt(max(rate * (1 - rate), 1e-9) / max(n, 1))
            like = n == 0 or abs(b / max(n, 1) - rate) <= p.z * spread
            return "*" if seg == "*" or len(nodes[node]) > 1 and like else seg

        names = [[rename((host, tuple(name[:d])), seg) for d, seg in enumerate(shape)]
                 for (host, _), shape, name in zip(at, shapes, names)]
    templates = ["".join("/" + x for x in n) for n in names]
    known = [b for b in bad if b is not None]
    overall = (sum(known) + 1) / (len(known) + 2)

    def count(same):
        own = [b for i, b in enumerate(bad) if same(i) and b is not None]
        return len(own), sum(own)

    out = []
    for i, (host, _) in enumerate(at):
        n, b = count(lambda j: at[j][0] == host)
        m, c = count(lambda j: at[j][0] == host and templates[j] == templates[i])
        out.append((templates[i], (c + p.prior * (b + p.prior * overall) / (n + p.prior)) / (m + p.prior)))
    return out


def test_templates_purity_and_verdict_against_brute_force(spark):
    r = random.Random(3)
    given, bad = list(GIVEN), [None] * len(GIVEN)
    for _ in range(500):
        host = r.choice(["hot.net"] * 3 + ["b.net", "c.org"])
        user = f"u{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}x"
        parts = r.choice([["user", user, r.choice(["spam", "home"]), str(r.randrange(99))], ["news", str(r.randrange(99))],
                          ["shop", r.choice(["cheap", "fair", "old"]), user], []])
        given.append(f"http://{host}/" + "/".join(parts))
        odds = 0.95 if "spam" in parts or "cheap" in parts else 0.05
        bad.append(int(r.random() < odds) if r.random() < 0.6 else None)
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad) if b is not None], "page_id long, bad int")
    out = {x.page_id: x for x in urls.judge(frame(spark, given), [], labels).collect()}
    want = brute_templates(given, bad, urls.TreeParams())
    assert len(out) == len(given) and "/user/*/spam/*" in {t for t, _ in want}
    for i, (template, purity) in enumerate(want):
        assert out[i].template == template and out[i].purity == pytest.approx(purity, abs=1e-12)
        assert out[i].verdict == ("block" if purity >= 0.5 else "allow")


def test_very_deep_paths_with_mixed_labels(spark):
    """The work does not grow with the depth: 5,000 segments, a label change at the end."""
    deep = "/".join(f"d{'abcdefghij'[i % 10]}x" for i in range(5000))
    given = [f"http://t.net/{deep}/{s}/{i}" for s in ("good", "bad") for i in range(20)]
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(0, 40, 2)], "page_id long, bad int")
    out = {x.page_id: x.verdict for x in urls.judge(frame(spark, given), [], labels).collect()}
    assert [out[i] for i in range(40)] == ["allow"] * 20 + ["block"] * 20
