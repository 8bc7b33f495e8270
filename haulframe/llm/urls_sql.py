"""The url query of operator 8 as DuckDB SQL, one group of subqueries per level of the tree.

The statement has a fixed number of levels; a row whose path has more
segments is missing from its result.
"""

from __future__ import annotations

from haulframe.llm.urls import A_TO_Z, SHAPES, Rule, Tree


def _parts(a: str, b: str, z: float) -> str:
    """Whether the shares of two groups (prefixes of their ``seen`` and ``fine``) differ by the z test."""
    s, f, t, g = f"{a}seen", f"{a}fine", f"{b}seen", f"{b}fine"
    return (f"({s} * {t} > 0 AND ({f} * {t} - {g} * {s})::DOUBLE * ({f} * {t} - {g} * {s}) > {z ** 2!r} * (({f} + {g}) / greatest({s} + {t}, 1))"
            f" * (1 - ({f} + {g}) / greatest({s} + {t}, 1)) * ({s} + {t}) * ({s} * {t})::DOUBLE)")


def verdict_sql(rules: list[Rule], tree: Tree = Tree(), levels: int = 4) -> str:
    longest = sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True)
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in longest) + " END"
    known = "CASE rule " + " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in rules) + " END"
    shaped = "s"
    for pattern, name in SHAPES:
        shaped = f"regexp_replace({shaped}, '{pattern}', '{name}', 'g')"
    segs = f"list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {shaped})"
    w = tree.weight
    out = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, '{A_TO_Z}', '{A_TO_Z.lower()}') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
k AS (SELECT *, {rule} AS rule, {segs} AS segs FROM p),
r AS (SELECT *, {known} AS known FROM k),
paths AS (SELECT host, segs, count(known) AS seen, count(*) FILTER (WHERE known = 'allow') AS fine FROM r GROUP BY ALL),
whole AS (SELECT (coalesce(sum(fine), 0) + {w} * 0.5) / (coalesce(sum(seen), 0) + {w}) AS purity FROM paths),
hosts AS (SELECT host, string_split(host, '.') AS labels, sum(seen) AS seen, sum(fine) AS fine FROM paths GROUP BY host),
steps AS (SELECT host, seen, fine, unnest(range(1, len(labels) + 1)) AS n, labels FROM hosts),
doms AS (SELECT *, array_to_string(labels[len(labels) - n + 1:], '.') AS domain FROM steps),
sums AS (SELECT domain, sum(seen) AS s, sum(fine) AS f FROM doms GROUP BY domain),
chain AS (SELECT host, list([f::DOUBLE, s::DOUBLE] ORDER BY n) AS c FROM doms JOIN sums USING (domain) GROUP BY host),
n0 AS (SELECT paths.*, list_reduce(list_concat([[whole.purity::DOUBLE, 0.0]], c), lambda a, d: [(d[1] + {w} * a[1]) / (d[2] + {w}), 0.0])[1] AS purity,
              '' AS template FROM paths JOIN chain USING (host), whole)"""
    for i in range(levels):
        out += f""",
g{i} AS (SELECT *, segs[{i + 1}] AS seg FROM n{i} WHERE len(segs) > {i}),
c{i} AS (SELECT host, template, seg, sum(seen) AS seen, sum(fine) AS fine FROM g{i} GROUP BY ALL),
f{i} AS (SELECT *, count(*) OVER w AS kids, sum(seen) OVER w - seen AS o_seen, sum(fine) OVER w - fine AS o_fine FROM c{i} WINDOW w AS (PARTITION BY host, template)),
d{i} AS (SELECT *, {_parts("", "o_", tree.z)} AS differs FROM f{i}),
l{i} AS (SELECT *, lag(seen) OVER w AS p_seen, lag(fine) OVER w AS p_fine FROM d{i} WHERE differs
         WINDOW w AS (PARTITION BY host, template ORDER BY fine / seen, seg)),
a{i} AS (SELECT *, sum(coalesce({_parts("", "p_", tree.z)}, true)::INT) OVER (PARTITION BY host, template ORDER BY fine / seen, seg) AS branch FROM l{i}),
e{i} AS (SELECT host, template, seg, seen, fine, CASE WHEN count(*) OVER w = 1 THEN seg ELSE '{{' || min(seg) OVER w || '+' || (count(*) OVER w - 1) || '}}' END AS name
         FROM a{i} WINDOW w AS (PARTITION BY host, template, branch)
         UNION ALL SELECT host, template, seg, seen, fine, CASE WHEN kids = 1 THEN seg ELSE '*' END FROM d{i} WHERE NOT differs),
b{i} AS (SELECT host, template, name, sum(seen) AS seen, sum(fine) AS fine FROM e{i} GROUP BY ALL),
n{i + 1} AS (SELECT g.host, g.segs, g.seen, g.fine, (b.fine + {w} * g.purity) / (b.seen + {w}) AS purity, g.template || '/' || b.name AS template
             FROM g{i} g JOIN e{i} e USING (host, template, seg) JOIN b{i} b ON b.host = e.host AND b.template = e.template AND b.name = e.name
             UNION ALL SELECT host, segs, seen, fine, purity, template FROM n{i} WHERE len(segs) <= {i})"""
    return out + f"""
SELECT r.page_id, r.host, r.path, r.rule,
       coalesce(r.known, CASE WHEN n.purity < {tree.least_purity} THEN 'block' ELSE 'allow' END) AS verdict, n.template
FROM r JOIN n{levels} n ON n.host = r.host AND n.segs = r.segs WHERE len(r.segs) <= {levels}
"""
