"""Cross-site boilerplate lines, by distinct-site spread.

For each line hash, HyperLogLog sketches of the sites merge by aggregation. Lines whose estimate is far above
the threshold are boilerplate outright; lines near it get an exact distinct count. Every occurrence but the
first (smallest id, then smallest position) is removed. DataFrame functions only.

Defined results: a null text has no lines and stays null; an empty text is one empty line; very long texts are split
whole; a null site counts for no spread; lines shorter than
``min_chars`` code points are never boilerplate; rows are told apart by id and text, so repeated rows are treated
alike (an exact repeat of the first occurrence keeps the line too); other columns pass through, whatever their names
(columns named n_lines and n_removed are replaced); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, read

MIN_SITES = 8
MIN_CHARS = 1
LG_K = 12


def _lines(text):
    return F.split(text, "\n", -1)


def keyed_lines(docs: DataFrame, id_col: str, site_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per candidate line: the row's id and text hash, site, position, and a 128-bit line hash in two columns."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"), F.col(site_col).alias("_site"), F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line"))
    rows = rows.where(F.char_length("_line") >= min_chars)
    return rows.select("_id", "_row", "_site", "_pos", F.xxhash64("_line").alias("_k1"), F.xxhash64(F.lit(1), F.col("_line")).alias("_k2"))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """_k1, _k2, _first (struct of id, row, position), n_sites: the lines found on ``min_sites`` sites or more.

    The sketch's standard error is about 1.04 / 2**(lg_k / 2); the band that gets exact counts is eight of them wide on either side.
    """
    band = 8 * 1.04 / 2 ** (lg_k / 2)
    spread = lines.groupBy("_k1", "_k2").agg(
        F.hll_sketch_agg("_site", F.lit(lg_k)).alias("_sketch"),
        F.min(F.struct("_id", "_row", "_pos")).alias("_first"),
    )
    spread = spread.select("_k1", "_k2", "_first", F.coalesce(F.hll_sketch_estimate("_sketch"), F.lit(0)).alias("_estimate"))
    spread = pinned(spread.where(F.col("_estimate") >= min_sites * (1 - band)))
    clear = spread.where(F.col("_estimate") > min_sites * (1 + band)).select("_k1", "_k2", "_first", F.col("_estimate").alias("n_sites"))
    near = spread.where(F.col("_estimate") <= min_sites * (1 + band))
    sites = lines.groupBy("_k1", "_k2", "_site").agg(F.lit(1).alias("_one"))  # map-side first: a common line has a row per site and task, not per occurrence
    exact = sites.join(near.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.count("_site").alias("n_sites"))
    near = near.join(exact.where(F.col("n_sites") >= min_sites), ["_k1", "_k2"]).select("_k1", "_k2", "_first", "n_sites")
    return clear.unionByName(near)


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents with their text less the boilerplate lines, and n_lines and n_removed beside.

    Only hashes and positions go through the joins on lines; each text is moved once, for the last join.
    """
    lines = pinned(keyed_lines(docs, id_col, site_col, text_col, min_chars))
    found = boilerplate(lines, min_sites)
    hits = lines.join(found, ["_k1", "_k2"]).where(~F.struct("_id", "_row", "_pos").eqNullSafe(F.col("_first")))
    removed = hits.groupBy("_id", "_row").agg(F.array_sort(F.collect_set("_pos")).alias("_removed"))
    # the row as it is goes into one column, so that no name of it can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(id_col).alias("_key"), F.xxhash64(text_col).alias("_hash"))
    out = rows.join(removed, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")
    whole = F.col("_doc")[text_col]
    out = out.select("_doc", "_removed", F.when(F.col("_removed").isNotNull(), _lines(whole)).alias("_text_lines"))
    start = lambda i: F.when(i == 0, 1).otherwise(F.get(F.col("_removed"), i - 1) + 2)
    end = lambda i: F.coalesce(F.get(F.col("_removed"), i), F.size(F.col("_text_lines")))
    parts = F.transform(F.sequence(F.lit(0), F.size("_removed")), lambda i: F.slice(F.col("_text_lines"), start(i), F.greatest(end(i) - start(i) + 1, F.lit(0))))
    text = F.when(F.col("_removed").isNull(), whole).otherwise(F.array_join(F.flatten(parts), "\n"))
    n_lines = F.when(whole.isNull(), 0).otherwise(F.size(_lines(whole))).cast("long")
    n_removed = F.coalesce(F.size("_removed"), F.lit(0)).cast("long")
    made = {text_col: text, "n_lines": n_lines, "n_removed": n_removed}
    return out.select(*(made.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns), *(made[c].alias(c) for c in ("n_lines", "n_removed") if c not in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_lines", "n_removed", "text")


OP10_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), found AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM lines
  WHERE length(line) >= {MIN_CHARS} GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND f.first <> struct_pack(d := l.doc_id, p := l.pos) AS gone
  FROM lines l LEFT JOIN found f ON l.line = f.line
), made AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE m.text END AS text
FROM documents d LEFT JOIN made m ON d.doc_id = m.doc_id
"""
