import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import neardup as N

SCHEMA = "doc_id long, text string, kept string, node long, size long"


def brute(rows, k, threshold):
    """doc_id -> (set size, component) by comparing all sets that share a shingle."""
    sets = defaultdict(set)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[i] |= {frozenset(s)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    has = defaultdict(set)
    for i, ss in sets.items():
        for s in ss:
            for x in s:
                has[x].add((i, s))
    for found in has.values():
        found = sorted(found, key=lambda x: x[0])
        for a, s in found:
            for b, r in found:
                if a < b and find(a) != find(b) and 100 * len(s & r) >= threshold * len(s | r):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: find(i) for i in sets}


def result(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


@pytest.mark.parametrize(("k", "threshold"), [(3, 85), (5, 80)])
def test_matches_brute_force_on_documents(spark, sf, k, threshold):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(N.near_duplicates(docs, k=k, threshold=threshold)) == brute(rows, k, threshold)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("limits", [(1024, 1024), (16, 8)])
def test_large_group_of_near_copies(spark, limits):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(150)]
    rows += [(1000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))) for i in range(30)]
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)
    got = result(N.near_duplicates(docs, k=3, threshold=85, node_limit=limits[0], cluster_limit=limits[1]))
    assert got == brute(rows, 3, 85)


def test_members_of_different_blocks_meet(spark, monkeypatch):
    """Texts of one template whose signatures are the same: no coordinate branches."""
    monkeypatch.setattr(N, "DEPTH", 1)
    same = bytearray(4 * N.COORDINATES)
    reps = spark.createDataFrame([(i, same) for i in range(60)], "rep long, sig binary")
    groups = defaultdict(set)
    for r in N.leaves(reps, 80, 1, 16).collect():
        groups[r["node"]].add(r["rep"])
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert len(met) == 60 * 59 // 2
    assert max(map(len, groups.values())) < 40


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Two words"), (5, "two  WORDS"), (6, "two words x"), (None, "two words"), (7, "a b c d"), (7, "a b c d"), (8, "É b c d"), (9, "é b c d")]
    rows.append((10, "long " * 50_000))
    docs = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)
    out = N.near_duplicates(docs, k=3, threshold=85)
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in out.collect()))
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 2, 7), (7, 2, 7), (8, 2, 8), (9, 2, 9), (10, 1, 10)]
    kept = N.drop_near_duplicates(docs, k=3, threshold=85)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 7, 8, 9, 10]
    assert N.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_query_columns(spark, sf):
    assert N.op5_near_dedup(spark, sf).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_groups_of_many_bytes_meet_block_by_block(spark):
    rng = np.random.default_rng(2)
    rows = [(g, r, rng.bytes(100)) for g in (1, 2) for r in range(40 if g == 1 else 3)]
    members = spark.createDataFrame(rows, "cluster long, rep long, full binary")
    groups = {}
    for r in N.bounded(members, "cluster", "full", limit=1000).collect():
        groups.setdefault(r["cluster"], set()).add(r["rep"])
    assert all(sum(100 for _ in m) <= 2000 for m in groups.values())
    met = {frozenset((a, b)) for m in groups.values() for a in m for b in m if a < b}
    assert met >= {frozenset((a, b)) for a in range(40) for b in range(a)}


def test_recall_on_a_group_above_the_default_limits(spark):
    """Variants of one text, most pairs near the threshold: more than a node or a cluster takes, at every level."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1600):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, threshold=85).collect()}
    assert sum(got[i] == find(i) for i in range(len(rows))) >= 0.99 * len(rows)
