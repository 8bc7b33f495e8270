"""Operator 12: every node against a plain trie, on random turns dealt over partitions; odd rows; long runs of equal conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from haulframe.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, n int"


def sequences(rows):
    """The rebuilt conversations of the query's contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role, digest, text))
    turns = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        leader = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = turns.get(leader, [])[:h] + turns[c][h:]
    return out


def brute(found):
    members = defaultdict(set)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    kids, rows = defaultdict(list), []
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in kids[node]) or 1
        saved = sum(sums[k][1] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        sums[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[node]) if len(found[c]) == len(node))
        rows.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]),
                     leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def randoms(seed, convs, words, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 4 * convs), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(words)))
    return rows


ODD = [(1, None, None, None), (1, None, "", ""), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, 5, None, "é" * 100_000),
       (None, 0, "user", "lost"), (None, None, None, None), (5, 0, "user", "b"), (7, 0, "us", "era"), (8, 0, "user", "a"), (-3, 1, "a", "x"),
       (0, 2, "a", "x"), (-2 ** 62, 0, "a", "x")] + [(100 + i, t, "user", "same") for i in range(60) for t in range(12)]


@pytest.mark.parametrize("rows, partitions", [
    (ODD, 3), ([], 2), (randoms(1, 120, ["a", "b"], 14), 7), (randoms(2, 80, ["a", "bb", "é"], 5), 1), (randoms(3, 60, ["x"], 20), 11),
    ([(9, 0, "u", "only")], 3), (randoms(4, 300, ["a"], 2), 8)])
def test_nodes_against_a_plain_trie(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
        out = [tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(df)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(out, key=str) == brute(sequences(rows))


def sorted_parts(found, cuts):
    """Keys of the conversations in order, cut into partitions, as batches."""
    rows = sorted((b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] for t in turns), c, [len(t[1].encode()) for t in turns])
                  for c, turns in found.items())
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        yield [{"conv_id": c, "key": k, "sizes": s} for k, c, s in rows[a:b]]


def test_lists_are_whole_however_they_are_cut(monkeypatch):
    """Pieces of three ids, partitions that begin and end inside a run of equal conversations."""
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    found = {c: [("u", "a")] * (1 + c % 3) for c in range(40)}
    pieces = []
    for number, rows in enumerate(sorted_parts(found, [2, 9, 10, 11, 30])):
        batch = pa.RecordBatch.from_pylist(rows)
        pieces += [r for r in prefix_trie._partition_rows([batch], number) if r["kind"] == "list"]
    lists = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p["key"], p["conv_id"])):
        assert p["n"] <= 3
        lists[p["key"]] += map(int, p["ids"].split(","))
    assert sorted(lists.values()) == [[c for c in range(40) if c % 3 == k] for k in range(3)]


def test_a_partition_hands_over_its_border_paths_only():
    """Ten thousand conversations in one partition: as many items as the two borders have depths."""
    import pyarrow as pa

    found = {c: [("u", str(c // 10 ** k)) for k in (3, 2, 1, 0)] for c in range(10_000)}
    (rows,) = sorted_parts(found, [])
    kinds = defaultdict(int)
    for r in prefix_trie._partition_rows([pa.RecordBatch.from_pylist(rows)], 0):
        kinds[r["kind"]] += 1
    assert kinds["item"] <= 2 * 5 and kinds["node"] > 10_000


def test_common_turns():
    a, b = bytes(64), bytes(40) + b"x" * 24
    assert prefix_trie.lcp(a, a) == 4 and prefix_trie.lcp(a, a[:32]) == 2 and prefix_trie.lcp(a, b) == 2 and prefix_trie.lcp(b"", a) == 0
