"""Operator 8: hosts, paths and rules against plain Python; template verdicts on planted hosts."""

import re

from haulframe.llm import urls
from haulframe.llm.queries import URL_RULES

URLS = [
    "http://A.Example.ORG/es/1?x=/#y", "https://example.org", "https://example.org/en/12", "https://sub.example.org/en/2", "http://notexample.org/es/",
    "ftp://x.com/fr/a", "http://com/de/b", "http://x.com/de?q", "http://É.com/de/", None, "", "no scheme", "://", "http://?q", "http://h#f/de/",
    "a://b://c/d", "http://x.net/" + "s/" * 3000, "http://org/", "HTTP://X.ORG", "http://x.com/FR/", "http://y.com//fr/", "http://h.org/es\n/x?",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, host string").repartition(3)
    out = {r.page_id: r for r in urls.verdicts(df, URL_RULES).collect()}
    assert len(out) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        host, path, rule, verdict = brute(u)
        r = out[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_templates_by_labelled_purity(spark):
    """A bad section of a host goes, good and unlabelled ones stay, numbers and ids are generalised."""
    rows = []
    for i in range(60):
        rows += [(f"http://h.test/spam/{i}.html", False), (f"http://h.test/news/{i}.html", True), (f"http://h.test/blog/{i}", True),
                 (f"http://free.test/a-title-{chr(97 + i % 26)}{chr(97 + i // 26)}", None)]
    rows += [(f"http://g.test/{s}/{i}", i % 3 > 0) for s in ("one", "two") for i in range(50)]
    rows += [("http://h.test/spam/999.html", None), ("http://h.test/news/999.html", None), ("http://h.test/other/1", None)]
    df = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id bigint, url string, fine boolean")
    from pyspark.sql import functions as F
    out = {r.page_id: r for r in urls.verdicts(df, [], good=F.col("fine")).collect()}
    by = {rows[i][0]: r for i, r in out.items()}
    assert by["http://h.test/spam/999.html"].verdict == "block" and by["http://h.test/spam/999.html"].template == "/spam/{n}.html"
    assert by["http://h.test/news/999.html"].verdict == "allow"
    # news and blog differ from their siblings, half of them bad, and not from each other
    assert by["http://h.test/news/999.html"].template == by["http://h.test/blog/1"].template == "/{blog+1}/*"
    assert by["http://h.test/other/1"].template == "/*/{n}" and by["http://g.test/one/1"].template == "/*/{n}"  # these do not
    assert by["http://h.test/other/1"].verdict == "allow"
    assert {r.template for r in out.values() if r.host == "free.test"} == {"/*"}
    assert all(0 <= r.purity <= 1 for r in out.values())


def test_frequent_sections_among_many_one_off_slugs(spark):
    """However many slugs are seen once, a bad and a good section keep their own verdicts, and the slugs stay together."""
    from pyspark.sql import functions as F
    rows = []
    for host, bad, fine, slugs in (("bad.test", 400, 100, 40), ("good.test", 100, 400, 40), ("few.test", 400, 100, 4)):
        rows += [(f"http://{host}/de/{i}", False) for i in range(bad)] + [(f"http://{host}/fr/{i}", True) for i in range(fine)]
        rows += [(f"http://{host}/de/x", None), (f"http://{host}/fr/x", None)]
        rows += [(f"http://{host}/slug-{chr(97 + i % 26)}{chr(97 + i // 26)}", None) for i in range(slugs)]
    df = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id bigint, url string, fine boolean")
    by = {rows[r.page_id][0]: r for r in urls.verdicts(df, [], good=F.col("fine")).collect()}
    for host in ("bad.test", "good.test", "few.test"):
        de, fr = by[f"http://{host}/de/x"], by[f"http://{host}/fr/x"]
        assert de.verdict == "block" and de.template.startswith("/de/")
        assert fr.verdict == "allow" and fr.template.startswith("/fr/")
        assert {r.template for u, r in by.items() if u.startswith(f"http://{host}/slug-")} == {"/*"}


def test_sections_that_differ_far_down(spark):
    """Sections that part at the fifth segment or later have templates and verdicts of their own."""
    from pyspark.sql import functions as F
    rows = []
    for i in range(60):
        rows += [(f"http://h.test/content/site/en/us/spam/{i}.html", False), (f"http://h.test/content/site/en/us/news/{i}.html", True),
                 (f"http://d.test/a/b/c/d/e/f/spam/{i}", False), (f"http://d.test/a/b/c/d/e/f/news/{i}", True)]
    far = [("http://h.test/content/site/en/us/spam/x/y/1", "block", "/content/site/en/us/spam/*/y/{n}"),
           ("http://h.test/content/site/en/us/news/999.html", "allow", "/content/site/en/us/news/{n}.html"),
           ("http://d.test/a/b/c/d/e/f/spam/999", "block", "/a/b/c/d/e/f/spam/{n}"),
           ("http://d.test/a/b/c/d/e/f/news/999", "allow", "/a/b/c/d/e/f/news/{n}"),
           ("http://one.test/a/b/c/d/e/f/g", "allow", "/a/b/c/d/e/f/g")]
    rows += [(u, None) for u, _, _ in far]
    df = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id bigint, url string, fine boolean")
    by = {rows[r.page_id][0]: r for r in urls.verdicts(df, [], good=F.col("fine")).collect()}
    assert len(by) == len(rows)
    for u, verdict, template in far:
        assert (by[u].verdict, by[u].template) == (verdict, template)


def parting(a, b, z=1.96):
    (s, f), (t, g) = a, b
    if s * t == 0:
        return False
    share = (f + g) / (s + t)
    return (f * t - g * s) ** 2 > z * z * share * (1 - share) * (s + t) * s * t


def brute_templates(rows, weight=4.0):
    """(host, segments) -> (template, purity), level by level in plain Python."""
    paths = {}
    for host, segs, good in rows:
        n = paths.setdefault((host, segs), [0, 0])
        n[0] += good is not None
        n[1] += good is True
    tops, whole = {}, [sum(n[k] for n in paths.values()) for k in (0, 1)]
    for (host, _), (s, f) in paths.items():
        labels = host.split(".")
        for n in range(1, len(labels) + 1):
            t = tops.setdefault(".".join(labels[-n:]), [0, 0])
            t[0], t[1] = t[0] + s, t[1] + f
    out = {}

    def smooth(n, p):
        return (n[1] + weight * p) / (n[0] + weight)

    def total(group):
        return [sum(paths[k][i] for k in group) for i in (0, 1)]

    def walk(group, depth, template, purity):
        for k in group:
            if len(k[1]) == depth:
                out[k] = template, purity
        kids = {}
        for k in group:
            if len(k[1]) > depth:
                kids.setdefault(k[1][depth], []).append(k)
        counts = {seg: total(g) for seg, g in kids.items()}
        whole = [sum(c[i] for c in counts.values()) for i in (0, 1)]
        apart = {seg for seg, c in counts.items() if len(kids) > 1 and parting(c, [whole[0] - c[0], whole[1] - c[1]])}
        branches, before = [], None
        for seg in sorted(apart, key=lambda x: (counts[x][1] / counts[x][0], x)):
            if before is None or parting(counts[before], counts[seg]):
                branches.append([])
            branches[-1].append(seg)
            before = seg
        named = {min(b) if len(b) == 1 else f"{{{min(b)}+{len(b) - 1}}}": b for b in branches}
        rest = [seg for seg in kids if seg not in apart]
        if rest:
            named[rest[0] if len(kids) == 1 else "*"] = rest
        for name, some in named.items():
            below = [k for seg in some for k in kids[seg]]
            walk(below, depth + 1, f"{template}/{name}", smooth(total(below), purity))

    for host in {h for h, _ in paths}:
        purity = (whole[1] + weight * 0.5) / (whole[0] + weight)
        labels = host.split(".")
        for n in range(1, len(labels) + 1):
            purity = smooth(tops[".".join(labels[-n:])], purity)
        walk([k for k in paths if k[0] == host], 0, "", purity)
    return out


def test_templates_against_a_tree_walk(spark):
    import random

    from pyspark.sql import functions as F
    rng = random.Random(11)
    bad = {"spam", "ads", "win", "pills"}
    rows = []
    for _ in range(1500):
        host = rng.choice(["a.x.net", "b.x.net", "x.net", "y.org", "deep.er.y.org", "localhost", ""])
        segs = [rng.choice(["spam", "news", "ads", "blog", "win", "pills", "faq"]) for _ in range(rng.choice([0, 1, 1, 2, 2, 3]))]
        segs = ["in", "all"] * (host == "y.org") + segs + ["page"] * (rng.random() < 0.2)
        share = 0.05 if bad & set(segs) else 0.95
        rows.append((host, tuple(segs), None if rng.random() < 0.3 else rng.random() < share))
    df = spark.createDataFrame([(i, f"http://{h}/" + "/".join(s), g) for i, (h, s, g) in enumerate(rows)], "page_id bigint, url string, fine boolean").repartition(5)
    want = brute_templates(rows)
    for r in urls.verdicts(df, [], good=F.col("fine")).collect():
        template, purity = want[rows[r.page_id][:2]]
        assert r.template == template and abs(r.purity - purity) < 1e-9, (rows[r.page_id], r.template, template)
    assert any("+" in t for t, _ in want.values())


def test_hosts_lean_on_their_sisters(spark):
    """A host without labels among bad hosts of its domain is blocked, one among good hosts is not."""
    from pyspark.sql import functions as F
    rows = [(f"http://h{i}.bad.net/p/{k}", False) for i in range(20) for k in range(5)] + [(f"http://h{i}.good.net/p/{k}", True) for i in range(40) for k in range(5)]
    rows += [("http://new.bad.net/x", None), ("http://new.good.net/x", None), ("http://new.other.net/x", None)]
    df = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id bigint, url string, fine boolean")
    by = {rows[r.page_id][0]: r for r in urls.verdicts(df, [], good=F.col("fine")).collect()}
    assert [by[f"http://new.{d}.net/x"].verdict for d in ("bad", "good", "other")] == ["block", "allow", "allow"]


def test_a_trap_of_two_hundred_segments_takes_a_few_rounds(spark, monkeypatch):
    """Paths that only go on or end are one chain: rounds follow the branchings, not the depth."""
    from pyspark.sql import functions as F
    rounds = []
    plain = urls._round
    monkeypatch.setattr(urls, "_round", lambda going, tree: rounds.append(1) or plain(going, tree))
    rows = [("http://trap.test/" + "/".join(["next"] * k), k % 2 == 0) for k in range(1, 200)]
    rows += [("http://trap.test/" + "/".join(["next"] * 150 + ["end", x]), x == "a") for x in "ab"]
    df = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id bigint, url string, fine boolean")
    out = {rows[r.page_id][0]: r for r in urls.verdicts(df, [], good=F.col("fine")).collect()}
    want = brute_templates([("trap.test", tuple(u.split("/")[3:]), g) for u, g in rows])
    for u, r in out.items():
        template, purity = want["trap.test", tuple(u.split("/")[3:])]
        assert r.template == template and abs(r.purity - purity) < 1e-9
    assert len(rounds) <= 4


def test_empty_table(spark):
    assert urls.verdicts(spark.createDataFrame([], "page_id bigint, url string"), URL_RULES).collect() == []
    one = urls.verdicts(spark.createDataFrame([(None, None)], "page_id bigint, url string"), URL_RULES).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in one] == [("", "", None, "allow")]
