"""Ranked lexical search: documents reordered by recursive graph bisection, a clustered index, visits by bound with exact stopping.

*Order.* A bounded sample of documents is bisected again and again, so that each half's documents share terms (the swaps
of recursive graph bisection: a document moves where the logarithmic gaps of its terms' lists get smaller). Each
bisection leaves a weight for each hashed term; every document goes down the tree by its terms' weights to a leaf. A leaf
is cut into shards of about as many postings each, so a shard fits one task whatever a leaf holds.

*Index.* A row for each shard and term: the list of the shard's documents (as places in the shard) with the term's
impact in each, and the largest impact. The place list leads back to document ids.

*Search.* A shard's bound for an item is the sum of its terms' weights times their largest impacts there. Items visit
their shards from the highest bound down, in rounds of growing width; what a round found gives each item a threshold, and
a shard whose bound is below it can't hold a better document (one with a bound equal to it can, by its id). Rounds go on
until no such shard is left, so the result is that of a search of everything.

Scores are whole numbers: sums of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over an item's terms, where
w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 50 + (50 n N) div L.

Defined results: a null or termless text has no terms, isn't counted in N and is never found; a null or termless item has
no result; items of one id are one item with the terms of all; terms of an item count once; documents with equal scores
go by ascending id, null ids last; repeated rows are ranked each; very long texts are indexed whole, and one longer than
a shard's share is a shard by itself or with few others; other columns aren't carried on; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, pinned, read, stored
from .whitening import arrow_schema_of

K = 50
#: Documents in the sample that the order is fitted on, levels of bisection, buckets of hashed terms, rounds of swaps by level.
SAMPLE, LEVELS, BUCKETS, SWAPS = 4096, 6, 1 << 16, 10
#: Postings in a shard, about; shards that an item visits in its first round, and growth of that number by round.
SHARD, FIRST, GROWTH = 400_000, 4, 8
#: Items that are scored together in one task.
BLOCK = 256
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased, as UTF-8."""
    return _TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Order(NamedTuple):
    """A tree of bisections: weights[node][bucket] speak for the left half, and a document above cut[node] goes there."""

    weights: np.ndarray
    cuts: np.ndarray
    buckets: int

    def leaves(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The leaf of each of some documents, given as the hashed terms of all of them and where each begins."""
        docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.zeros(len(offsets) - 1, np.int64)
        for _ in range(int(np.log2(len(self.cuts) + 1))):
            score = np.bincount(docs, self.weights[at[docs], buckets], len(at))
            at = 2 * at + np.where(score >= self.cuts[at], 1, 2)
        return at - len(self.cuts)


def bisected(docs: list[np.ndarray], levels: int = LEVELS, buckets: int = BUCKETS, swaps: int = SWAPS) -> Order:
    """The order fitted on documents given as distinct hashed terms."""
    nodes = 2**levels - 1
    weights, cuts = np.zeros((nodes, buckets), np.float32), np.zeros(nodes)

    def split(members: list[int], node: int) -> None:
        if node >= nodes:
            return
        if len(members) < 2:  # nothing to tell apart: both halves are the same
            split(members, 2 * node + 1)
            split([], 2 * node + 2)
            return
        terms = np.concatenate([docs[i] for i in members])
        rows = np.repeat(np.arange(len(members)), [len(docs[i]) for i in members])
        left = np.arange(len(members)) < (len(members) + 1) // 2
        weight = np.zeros(buckets)
        for _ in range(swaps):
            sizes = left.sum(), (~left).sum()
            degree = [np.bincount(terms[side[rows]], minlength=buckets).astype(float) for side in (left, ~left)]
            # a term's cost is d log2(n / (d + 1)) on each side; its weight is what it costs less on the left
            weight = np.log2((degree[0] + 1) / sizes[0]) - np.log2((degree[1] + 1) / sizes[1])
            score = np.bincount(rows, weight[terms], len(members))
            out, into = np.flatnonzero(left), np.flatnonzero(~left)
            out, into = out[np.argsort(score[out], kind="stable")], into[np.argsort(-score[into], kind="stable")]
            n = min(len(out), len(into))
            gains = score[into[:n]] - score[out[:n]]
            n = int((gains > 0).sum())
            if not n:
                break
            left[out[:n]], left[into[:n]] = False, True
        weights[node] = weight
        score = np.bincount(rows, weight.astype(np.float32)[terms], len(members))
        cuts[node] = (score[left].min() + score[~left].max()) / 2
        split([m for m, x in zip(members, left, strict=True) if x], 2 * node + 1)
        split([m for m, x in zip(members, left, strict=True) if not x], 2 * node + 2)

    split([i for i, d in enumerate(docs) if len(d)], 0)
    return Order(weights, cuts, buckets)


def _buckets(terms, n_buckets: int = BUCKETS):
    return F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(n_buckets)).cast("int"))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), terms, tfs of the documents that have any; one map."""

    def each(columns: list[list]) -> list:
        counted = [Counter(terms_of(t)) for t in columns[1]]
        some = [i for i, c in enumerate(counted) if c]
        terms = pa.array([list(counted[i]) for i in some], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        return [[columns[0][i] for i in some], [counted[i].total() for i in some], terms, [list(counted[i].values()) for i in some]]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), each, f"id {kind}, n long, terms array<string>, tfs array<int>", rows=64)


def sampled_order(docs: DataFrame, id_col: str, text_col: str, size: int = SAMPLE) -> Order:
    """The order fitted on about ``size`` documents chosen by a hash of id and length, with their distinct terms hashed; bounded by that number."""
    total = docs.count()
    grid = 1 << 30
    chosen = docs.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.length(F.col(f"`{text_col}`"))), F.lit(grid)) < int(min(1.0, size / max(total, 1)) * grid)).limit(2 * size)
    found = term_counts(chosen, id_col, text_col).select(F.array_sort(F.array_distinct(_buckets(F.col("terms")))).alias("b"), F.xxhash64("id", "n").alias("h")).toArrow().sort_by("h")
    return bisected([np.asarray(x.values, np.int64) for x in found["b"].combine_chunks()])


class Index(NamedTuple):
    """``lists``: shard, term (null: the shard's ids), places, impacts, top, ids. N and L count documents with terms, and terms."""

    lists: DataFrame
    N: int
    L: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD, order: Order | None = None) -> Index:
    """One read of the texts, one shuffle of term counts by shard."""
    spark = docs.sparkSession
    order = order or sampled_order(docs, id_col, text_col)
    shared = spark.sparkContext.broadcast(order)
    counts = term_counts(docs, id_col, text_col).withColumn("buckets", _buckets(F.col("terms"), order.buckets))
    fields = [f for f in counts.schema.fields if f.name != "buckets"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", leaf int"
    with_leaf = arrow_schema_of(ddl)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                b = part.column(4)
                offsets = np.append(0, np.cumsum(np.asarray(pc.list_value_length(b), np.int64)))
                leaf = tree.leaves(np.asarray(b.flatten(), np.int64), offsets)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(leaf.astype(np.int32))], schema=with_leaf)

    counts = stored(counts.mapInArrow(leaves, ddl))
    sizes = {r["leaf"]: (r["d"], r["n"], r["p"]) for r in counts.groupBy("leaf").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"), F.sum(F.size("terms")).alias("p")).collect()}
    N, L = sum(x[0] for x in sizes.values()), sum(x[1] for x in sizes.values())
    # shards are numbered leaf by leaf: a leaf of p postings has p / shard_postings of them
    first, many, at = {}, {}, 0
    for leaf in sorted(sizes):
        first[leaf], many[leaf] = at, max(1, round(sizes[leaf][2] / shard_postings))
        at += many[leaf]
    place = spark.createDataFrame([(leaf, first[leaf], many[leaf]) for leaf in first], "leaf int, first int, many int")
    shard = F.col("first") + F.pmod(F.xxhash64("id", "n"), F.col("many")).cast("int")
    dealt = counts.join(F.broadcast(place), "leaf").select(shard.alias("shard"), "id", "n", "terms", "tfs")  # a row for each leaf, so its size is fixed
    kind = dealt.schema["id"].dataType.simpleString()
    schema = f"shard int, term string, places array<int>, impacts array<int>, top int, ids array<{kind}>"
    target = arrow_schema_of(schema)

    def build(key, rows):
        rows = rows.combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("id", "ascending"), ("n", "ascending")]))
        terms, tfs = (rows[c].combine_chunks() for c in ("terms", "tfs"))
        counts_ = np.asarray(pc.list_value_length(terms), np.int64)
        codes = terms.flatten().dictionary_encode()
        of, tf = np.asarray(codes.indices, np.int64), np.asarray(tfs.flatten(), np.int64)
        places = np.repeat(np.arange(len(counts_), dtype=np.int32), counts_)
        m = 50 + (50 * N * np.asarray(rows["n"], np.int64)) // L
        impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m[places])
        by = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=len(codes.dictionary)))
        starts = np.append(0, ends)[:-1]
        cut = pa.array(np.append(starts, len(of)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cut, pa.array(v[by].astype(np.int32))) for v in (places, impacts)]
        top = np.maximum.reduceat(impacts[by], starts).astype(np.int32)
        n = len(top)
        found = pa.Table.from_arrays([pa.array([key[0].as_py()] * n, pa.int32()), codes.dictionary, *lists, pa.array(top), pa.nulls(n, target.field("ids").type)], schema=target)
        ids = rows["id"].combine_chunks()
        directory = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        head = pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.nulls(1, target.field(i).type) for i in range(1, 5)), directory], schema=target)
        return pa.concat_tables([head, found])

    lists = stored(dealt.groupBy("shard").applyInArrow(build, schema))
    discard(counts)
    return Index(lists, N, L)


def search(index: Index, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, rank, doc, score: the k best documents of each item."""
    spark = items.sparkSession
    wanted = map_rows(items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), lambda c: [c[0], [[t.decode("utf-8", "replace") for t in set(terms_of(x))] for x in c[1]]], f"item {items.schema[id_col].dataType.simpleString()}, terms array<string>", rows=64)
    wanted = pinned(wanted.where(F.col("item").isNotNull()).select("item", F.explode("terms").alias("term")).distinct())
    lists = index.lists
    # only the lists of the items' terms, and the shards' ids, are read from here on
    needed = stored(lists.join(wanted.select("term").distinct(), "term", "left_semi").select("shard", "term", "places", "impacts", "top"))
    df = needed.groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.N + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = pinned(wanted.join(df.select("term", weight.alias("w")), "term"))
    n_blocks = max(1, -(-weighted.select("item").distinct().count() // BLOCK))
    weighted = weighted.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int"))
    bounds = needed.select("shard", "term", "top").join(weighted, "term").groupBy("item", "block", "shard").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    left = pinned(bounds.where(F.col("bound") > 0))
    item_type, doc_type = weighted.schema["item"].dataType.simpleString(), lists.schema["ids"].dataType.elementType.simpleString()
    schema = f"item {item_type}, doc {doc_type}, score long"
    best = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    width = FIRST
    while True:
        nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
        going = pinned(left.withColumn("nth", nth).withColumn("now", F.col("nth") <= width))
        visits = going.where("now")
        floor = best.groupBy("item").agg(F.when(F.count("score") >= k, F.min("score")).otherwise(0).alias("floor"))
        asked = visits.select("item", "block", "shard").join(weighted.drop("block"), "item").join(floor, "item", "left").na.fill(0, ["floor"])
        blocks = visits.select("shard", "block").distinct()
        held = needed.select("shard", "term", "places", "impacts", F.lit(None).cast(f"array<{doc_type}>").alias("ids"))
        held = held.unionByName(lists.where(F.col("term").isNull()).select("shard", "term", "places", "impacts", "ids")).join(blocks, "shard")
        found = asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(_scorer(k, schema), schema)
        both = best.unionByName(found).withColumn("rank", rank).where(F.col("rank") <= k)
        best = pinned(both.drop("rank"))
        floor = best.groupBy("item").agg(F.when(F.count("score") >= k, F.min("score")).otherwise(0).alias("floor"))
        left = pinned(going.where(~F.col("now")).drop("nth", "now").join(floor, "item", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0))).drop("floor"))
        if left.isEmpty():
            break
        width *= GROWTH
    discard(needed)
    return best.select("item", rank.alias("rank"), "doc", "score")


def _scorer(k: int, schema: str):
    target = arrow_schema_of(schema)

    def score(key, asked, held):
        nothing = pa.Table.from_batches([], schema=target)
        if not asked.num_rows or not held.num_rows:
            return nothing
        held = held.combine_chunks()
        head = held.filter(pc.is_null(held["term"]))
        ids = head["ids"].combine_chunks().flatten()
        place = {t: i for i, t in enumerate(held["term"].to_pylist()) if t is not None}
        cut = {}
        for name in ("places", "impacts"):
            column = held[name].combine_chunks()
            cut[name] = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64))), np.asarray(column.flatten(), np.int64)
        offsets, places = cut["places"]
        impacts = cut["impacts"][1]
        rows = zip(asked["item"].to_pylist(), asked["term"].to_pylist(), asked["w"].to_pylist(), asked["floor"].to_pylist(), strict=True)
        by_item: dict = {}
        for item, term, w, floor in rows:
            if (i := place.get(term)) is not None:
                by_item.setdefault(item, (floor, []))[1].append((i, w))
        out = []
        total = np.zeros(len(ids), np.int64)
        for item, (floor, terms) in by_item.items():
            total[:] = 0
            for i, w in terms:
                a, b = offsets[i], offsets[i + 1]
                total[places[a:b]] += w * impacts[a:b]
            least = max(floor, 1)
            if len(total) > k:
                least = max(least, int(np.partition(total, len(total) - k)[len(total) - k]))
            some = np.flatnonzero(total >= least)
            made = pa.table({"doc": ids.take(pa.array(some)), "score": pa.array(total[some])})
            made = made.take(pc.sort_indices(made, [("score", "descending"), ("doc", "ascending")])[:k])
            out.append(pa.Table.from_arrays([pa.array([item] * len(made), target.field("item").type), made["doc"].cast(target.field("doc").type), made["score"]], schema=target))
        return pa.concat_tables(out) if out else nothing

    return score


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = search(index, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    discard(index.lists)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + _PATTERN + "'))"
OP13_SQL = f"""
WITH words AS (SELECT rowid AS row, doc_id, {_WORDS} AS term FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents WHERE text IS NOT NULL)),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT row, sum(tf)::BIGINT AS n FROM counts GROUP BY row),
sizes AS (SELECT count(*)::BIGINT AS N_, sum(n)::BIGINT AS L_ FROM docs),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_WORDS} AS term FROM benchmark WHERE text IS NOT NULL)),
weights AS (SELECT term, floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sizes WHERE term IN (SELECT term FROM asked) GROUP BY term, N_),
scored AS (
  SELECT item_id, c.row, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * N_) // L_)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts c USING (term) JOIN docs d ON c.row = d.row, sizes GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {K}
"""
