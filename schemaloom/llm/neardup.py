"""Near-duplicates by a chosen-path set similarity join.

Each distinct shingle set gets a signature of minwise tokens. In each of several independent trees, a document goes
down to the children named by its tokens at the coordinates that the node selects (one, and a second one with
probability 1 / threshold - 1). A node of ``node_limit`` members or fewer is small: its members are compared
exhaustively by their signatures; larger ones branch again. The plausible pairs only say which documents have to be
compared at all; links are confirmed on the full sets.

Ids are whole numbers (cast to long). Nothing is emitted per pair. A small node gives a spanning forest of its plausible pairs; the connected components of
those are clusters. Sets of a cluster of ``cluster_limit`` members or fewer meet in one task, which confirms links
until its components are known. A larger cluster is never brought together: its sets meet in the small nodes of each
tree, and the confirmed links are joined up by distributed components.

Recall: two documents of similarity s share a node at depth d of one of t trees with probability 1 - (1 - s**d)**t at
least. With 12 trees and a threshold of 0.85 that is 1 - 1e-10 at depth 1 (where nearly all nodes are small), and
1 - 2e-4 at depth 4, for pairs exactly at the threshold in a node of thousands; such pairs also are linked through others.
Signatures let a pair at the threshold through unless it is 5 standard deviations off.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of
fewer words than a shingle has one shingle, all its words; a null id is linked with nothing, has a null component and
is kept; very long texts are read whole, and groups of many bytes are compared block by block; the least id of a
component stays, whatever its text; different texts under one id count as one document; repeated rows are one class; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, pinned, read
from .graph import components

COORDINATES = 64
TREES = 12
DEPTH = 24
NODE_LIMIT = 1024
CLUSTER_LIMIT = 1024
#: Full sets of at most about this many bytes meet in one group.
GROUP_BYTES = 16 << 20
#: As many representatives' ids are broadcast at most when their texts are read again; more are joined with a shuffle.
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | bytes | None, k: int, words: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; A-Z in lower case, words between spaces and \\x09-\\x0D."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    parts = raw.lower().split()
    n = len(parts)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    size = min(k, n)
    with np.errstate(over="ignore"):
        out = mixed(h[: n - size + 1] + np.uint64(size))
        for j in range(1, size):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate, as 32 bits."""
    out = np.empty(COORDINATES, np.uint32)
    with np.errstate(over="ignore"):
        for c in range(COORDINATES):
            out[c] = (s * _MULTIPLY[c] + _ADD[c]).min() >> np.uint64(32)
    return out


def least_agreement(threshold: int) -> int:
    p = threshold / 100
    return max(1, int(COORDINATES * p - 5 * (COORDINATES * p * (1 - p)) ** 0.5))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def plausible_forest(sigs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose signatures agree in ``least`` coordinates or more."""
    n, forest, out = len(sigs), Forest(len(sigs)), []
    for i in range(n - 1):
        for j in (np.flatnonzero((sigs[i + 1 :] == sigs[i]).sum(1) >= least) + i + 1).tolist():
            if forest.join(i, j):
                out.append((i, j))
    return out


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    n, m = len(a), len(b)
    if 100 * min(n, m) < threshold * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="mergesort")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= threshold * (n + m - shared)


def confirmed_forest(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of full sets; the most alike are tried first, and pairs already connected are not tried."""
    n, forest, out = len(sets), Forest(len(sets)), []
    sigs = np.stack([signature(s) for s in sets])
    least = least_agreement(threshold)
    tries: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        agree = (sigs[i + 1 :] == sigs[i]).sum(1)
        tries += [(-int(agree[j]), i, int(j) + i + 1) for j in np.flatnonzero(agree >= least)]
    for _, i, j in sorted(tries):
        if forest.find(i) != forest.find(j) and linked(sets[i], sets[j], threshold):
            forest.join(i, j)
            out.append((i, j))
    return out


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, 128-bit set hash in two columns, signature (null for an empty set)."""

    def each(words, columns):
        rows = []
        for text in columns[1]:
            s = shingles(text, k, words)
            h = xxhash.xxh3_128_intdigest(s.tobytes())
            rows.append((len(s), (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), signature(s).tobytes() if len(s) else None))
        return [columns[0], *map(list, zip(*rows, strict=True))]

    return map_rows(docs.select(id_col, F.col(text_col).cast("binary")), each, "id long, n_shingles long, h1 long, h2 long, sig binary", WordHashes)



def children(nodes: DataFrame, level: int, threshold: int) -> DataFrame:
    """rep, node -> rep, node one level down; needs sig. Which coordinates branch depends on the node and the level only."""
    own = F.pmod(F.xxhash64("node", F.lit(2 * level)), F.lit(COORDINATES))
    other = F.pmod(F.xxhash64("node", F.lit(2 * level + 1)), F.lit(1 << 20))
    second = F.pmod(own + 1 + F.pmod(other, F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    chosen = F.when(F.shiftright(other, 6) < int((100 / threshold - 1) * (1 << 14)), F.array(own, second)).otherwise(F.array(own))
    exploded = nodes.select("rep", "sig", "node", F.explode(chosen).alias("c"))
    return exploded.select("rep", F.xxhash64("node", "c", F.substring(F.col("sig"), (4 * F.col("c") + 1).cast("int"), F.lit(4))).alias("node"))


def leaves(reps: DataFrame, threshold: int, trees: int, node_limit: int) -> DataFrame:
    """node, rep: the members of small nodes of two or more, over all trees.

    Counts are aggregated map-side. Only members of nodes above the limit go down, so nearly all work is at the first level.
    A node that is still larger at the last level agrees in all chosen coordinates; its members are compared in
    pairs of blocks, so that each meets every other.
    """
    roots = reps.select("rep", "sig", F.explode(F.array(*(F.lit(t).cast("long") for t in range(trees)))).alias("node"))
    out = None
    for level in range(1, DEPTH + 1):
        down = children(roots, level, threshold)
        sizes = down.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = pinned(down.join(sizes, "node"))
        small = sized.where(F.col("size") <= node_limit).select("node", "rep")
        out = small if out is None else out.unionByName(small)
        large = sized.where(F.col("size") > node_limit).select("node", "rep")
        if large.isEmpty():
            return out
        roots = large.join(reps, "rep").select("rep", "sig", "node")
    return out.unionByName(block_pairs(large, node_limit))


def block_pairs(large: DataFrame, node_limit: int) -> DataFrame:
    """node, rep: every pair of members of a node meets in a group of about ``node_limit``.

    Nodes with members in common, of which there are many for the same texts, are taken together, so that a family is
    compared once. It is cut into blocks of half the limit, and each pair of blocks is a group.
    """
    half = max(1, node_limit // 2)
    least = large.groupBy("node").agg(F.min("rep").alias("least"))
    stars = large.join(least, "node").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    family = pinned(components(stars).select(F.col("node").alias("rep"), F.col("component").alias("family")))
    sizes = family.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / half), F.lit(2)).cast("long").alias("blocks"))
    cut = family.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block")
    return met.select(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("node"), "rep")


def bounded(members: DataFrame, key: str, value: str, limit: int = GROUP_BYTES) -> DataFrame:
    """key, rep, value: groups of more bytes than the limit are cut into blocks of half of it, and each pair of blocks is a group."""
    heavy = members.groupBy(key).agg(F.sum(F.octet_length(value)).alias("bytes")).where(F.col("bytes") > limit)
    heavy = pinned(heavy.select(F.col(key).alias("heavy"), F.ceil(F.col("bytes") * 2 / limit).cast("long").alias("blocks")))
    if not (n := heavy.count()):
        return members
    tagged = members.join(F.broadcast(heavy) if n <= BROADCAST_IDS else heavy, F.col(key) == F.col("heavy"), "left").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    others = F.when(F.col("heavy").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = tagged.withColumn("other", F.explode(others)).where("heavy IS NULL OR other <> block")
    return met.select(F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other")).alias(key), "rep", value)


def _grouped_edges(members: DataFrame, key: str, value: str, forest) -> DataFrame:
    """a, b: what ``forest`` gives for each group's list of (rep, value); groups are small by construction."""
    grouped = members.groupBy(key).agg(F.collect_list(F.struct("rep", value)).alias("members"))

    def each(columns):
        up: dict[int, int] = {}

        def least(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for group in columns[0]:
            group.sort(key=lambda m: (m["rep"], m[value]))
            for i, j in forest([m[value] for m in group]):
                a, b = least(group[i]["rep"]), least(group[j]["rep"])
                up[max(a, b)] = min(a, b)
        edges = [(x, least(x)) for x in up if least(x) != x]  # stars, so that the components take fewer rounds
        return [[a for a, _ in edges], [b for _, b in edges]]

    return map_rows(grouped.select("members"), each, "a long, b long")


def near_duplicates(
    docs: DataFrame, k: int = 5, threshold: int = 80, trees: int = TREES, node_limit: int = NODE_LIMIT, cluster_limit: int = CLUSTER_LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id (least id reachable by links of 100 * shared >= threshold * union) for each row."""
    every = pinned(signatures(docs, k, id_col, text_col))
    sets = every.where("n_shingles > 0 AND id IS NOT NULL").groupBy("n_shingles", "h1", "h2")
    reps = pinned(sets.agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    nodes = leaves(reps.select("rep", "sig"), threshold, trees, node_limit)
    least = least_agreement(threshold)
    plausible = _grouped_edges(nodes.join(reps.select("rep", "sig"), "rep"), "node", "sig", lambda sigs: plausible_forest(np.stack([np.frombuffer(s, np.uint32) for s in sigs]), least))
    clusters = pinned(components(plausible).select(F.col("node").alias("rep"), F.col("component").alias("cluster")))
    big = pinned(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > cluster_limit).select(F.col("cluster").alias("big")))
    # only the few big clusters are joined, so that members of one don't meet in a task just to learn its size
    clusters = clusters.join(F.broadcast(big) if big.count() <= BROADCAST_IDS else big, F.col("cluster") == F.col("big"), "left").select("rep", "cluster", F.col("big").isNotNull().alias("large"))

    wanted = clusters.select(F.col("rep").alias("_rep"))
    few = wanted.count() <= BROADCAST_IDS
    text = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("binary").alias("text"))
    text = text.join(F.broadcast(wanted) if few else wanted, F.col("rep") == F.col("_rep"), "left_semi")
    full = map_rows(text, lambda words, c: [c[0], [shingles(t, k, words).tobytes() for t in c[1]]], "rep long, full binary", WordHashes)
    full = pinned(full.where(F.octet_length("full") > 0).join(clusters, "rep"))

    confirm = lambda sets: confirmed_forest([np.frombuffer(s, np.uint64) for s in sets], threshold)
    links = _grouped_edges(bounded(full.where("NOT large"), "cluster", "full"), "cluster", "full", confirm)
    large = full.where("large").select("rep", "full")
    if not large.isEmpty():
        links = links.unionByName(_grouped_edges(bounded(nodes.join(large, "rep"), "node", "full"), "node", "full", confirm))
    found = components(links)

    classes = reps.join(found, F.col("rep") == F.col("node"), "left").select("n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    out = every.select("id", "n_shingles", "h1", "h2").join(classes, ["n_shingles", "h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component stays, with all its columns: the one with the least id (each row of that id, and rows without id)."""
    found = near_duplicates(docs, id_col=id_col, **options)
    name = next(n for n in ("_gone", *(f"_gone{i}" for i in range(len(docs.columns)))) if n not in docs.columns)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"), k=3, threshold=85)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
