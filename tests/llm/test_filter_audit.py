"""Operator 13: every count against plain Python on odd rows; empty tables."""

import re
from collections import Counter
from itertools import permutations

import pytest

from haulframe.llm import filter_audit

WORDS = " ".join(f"w{i}" for i in range(60))
TEXTS = [WORDS, WORDS.upper(), WORDS + " # ", "a " * 70, "short", None, "", " \t\n", "é" * 30 + " " + WORDS, "AB CD " + WORDS,
         "x\x0by\x0cz " * 30, WORDS.replace("w1", "W1"), "long " * 200_000]
ROWS = ([(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(100 + i, t, "s0") for i, t in enumerate(TEXTS[:4] * 3)]
        + [(7, WORDS, None), (7, WORDS, None), (7, "short", ""), (None, WORDS, "s1"), (None, "short", "s1"), (-5, "short", "only copies"), (500, "short", "only copies")])
LABELS = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (2, 0, 0), (7, 1, None), (7, 1, 0), (101, 1, 0), (None, 1, 1), (3, None, 1)]


def brute(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = {}, Counter()
    for part in {s or "" for _, _, s in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(5):
                out[part, order, step + 1] = Counter()
    for i, t, s in rows:
        t, part = t or "", s or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {x for x, bad in zip("ABCDE", (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and i > first[t])) if bad}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order):
                c = out[part, order, step + 1]
                c["kept"] += not gone and f not in fails
                c["removed"] += not gone and f in fails
                c["redundant"] += gone and f in fails
                c["unique_fails"] += fails == {f}
                c["good_lost"] += not gone and f in fails and i in good
                c["toxic_lost"] += not gone and f in fails and i in toxic
                shapley[part, f] += not gone and f in fails
                gone = gone or f in fails
    for (part, order, step), c in out.items():
        c["shapley"] = shapley[part, order[step - 1]]
    return out


@pytest.mark.parametrize("rows", [ROWS, []])
def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, mask string, n int").repartition(4)
    labels = spark.createDataFrame(LABELS if rows else [], "doc_id bigint, quality int, toxic int")
    out = filter_audit.audit(filter_audit.masks(docs, labels)).collect()
    want = brute(rows, LABELS)
    assert len(out) == len(want)
    for r in out:
        c = want[r.part, r.filter_order, r.step]
        for k in (*filter_audit.COUNTS, "shapley"):
            assert r[k] == c[k], (r.part, r.filter_order, r.step, k)
