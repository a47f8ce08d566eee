"""URL verdicts: rules by host and path, and a logistic regression on hashed character n-grams for the rest.

A rule is (verdict, host, path). It fits its host and all subdomains of it where the URL's path starts with the rule's;
the longest rule (host and path together) decides, of equally long ones that with the longer host, then the first by text.
What no rule fits is judged by the model: n-grams of host and path, hashed to a fixed number of buckets, weights from a
small labelled table of URLs. DataFrame functions only: the gradient is an aggregate by bucket, the weights are one
array of fixed length, and a score is an expression over the row, so that judging is a narrow map without a shuffle.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, and is judged by the model
(no n-grams: the intercept alone); a URL without a path fits no rule whose path isn't empty; very long URLs are taken
whole; a score of exactly ``limit`` is a block; rows are judged one by one, so repeated rows have equal results; other
columns pass through but host, path, rule, score and verdict, which are replaced; an empty table gives no rows. Labelled
rows with a null URL or label aren't learnt from; a labelled table without rows, or with one class only, is an error.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, read

BUCKETS = 1 << 15
SIZES = (3, 4, 5)
#: Rows that a labelled table may have, so that fitting is bounded.
MAX_LABELLED = 100_000

#: The rules of op11 (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Words of hosts that a training corpus doesn't want, and of hosts that it does; ``labelled_urls`` makes URLs of them.
UNWANTED = """casino poker slots jackpot roulette betting bets bet lottery gambling pills pharmacy viagra slimming adult porn xxx
escort sexcam dating spam farm linkfarm clickbait ads adserver banner track tracker popup malware phishing warez cracked
torrents payday loans replica giveaway cheap win free""".split()
WANTED = """library museum school college university science physics history garden kitchen recipes travel weather council
hospital clinic theatre cinema music guitar books reading writing poetry grammar language dictionary journal press
news radio report archive records maps atlas ocean river forest mountain birds animals farming harvest weaving pottery
painting gallery design building bridges railway cycling running football chess puzzles maths coding software compiler
kernel network hardware robotics space planets climate energy solar law court parliament economy market bank insurance
housing parents children health nutrition yoga church charity volunteer community forum question answer tutorial guide
review product shop catalogue support contact about careers events calendar photos stories essays translation freedom
winter window address tracks cheapside""".split()


#: Beginnings and ends of made-up names, so that an unknown name speaks for nothing.
SYLLABLES = "al ber con der en for gar hel in jo ker lin mor nor or par quin ros son ter un ver wes yor zan".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block): a small table made by rule. Every name, with and without an s at its end, comes with the same
    prefixes, endings and paths in either class, so that only names tell the two apart."""
    around = (
        "https://{}.com/", "https://www.{}.net/en/1234.html", "http://m.{}.org/fr/56789/",
        "http://blog.{}.example.com/de/2460?page=2&ref=x", "https://{}.example.net/es/13579#top", "https://www.{}.example.org/news/2024/index.html",
    )
    made = [a + b for i, a in enumerate(SYLLABLES) for b in (SYLLABLES[(3 * i + 5) % 25], SYLLABLES[(7 * i + 11) % 25])]
    rows = []
    for label, words in ((1, UNWANTED), (0, WANTED + made)):
        forms = [form for w in words for form in (w.removesuffix("s"), w.removesuffix("s") + "s")]
        for i, word in enumerate(forms):
            other = forms[(i + 7) % len(forms)]
            rows += [(url.format(name), label) for url in around for name in (word, f"{word}-{other}")]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct (rule, verdict) of the longest rule that fits, or null; one expression, for rules that a list holds."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules (array of rule, path, verdict, longest first): the rules that fit each of some distinct hosts.

    For rule lists of any length: suffixes of hosts are joined to the rules' hosts. ``rule_among`` picks by path.
    """
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keyed = hosts.select("host", F.explode(suffix).alias("_of"))
    listed = rules.select(F.col("host").alias("_of"), F.struct((-F.length(F.concat("host", "path"))).alias("a"), (-F.length("host")).alias("b"), F.concat("host", "path").alias("rule"), "verdict", "path").alias("r"))
    return keyed.join(listed, "_of").groupBy("host").agg(F.array_sort(F.collect_set("r")).alias("rules"))


def rule_among(rules: Column, path: Column) -> Column:
    first = F.get(F.filter(rules, lambda r: path.startswith(r["path"])), 0)
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


class Model(NamedTuple):
    """Weights of a logistic regression: the last one is the intercept."""

    weights: list[float]
    sizes: tuple[int, ...] = SIZES


def buckets_of(host: Column, path: Column, n_buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> Column:
    """The distinct buckets of a URL's n-grams. Words end at dots, dashes and the like, their ends are marked and n-grams stay
    within them; numbers in paths are all alike; host and path don't share n-grams."""
    grams = []
    words = {"h": F.regexp_replace(host, r"[^\p{L}\p{N}]+", "\\$^"), "p": F.regexp_replace(F.regexp_replace(path, r"[^\p{L}\p{N}]+", "\\$^"), "[0-9]+", "0")}
    for n in sizes:
        for mark, text in words.items():
            found = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit(rf"(?=([^$]{{{n - 1}}}.))"), F.lit(1))
            grams.append(F.transform(found, lambda g, mark=mark: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(n_buckets)).cast("int")))
    return F.array_distinct(F.concat(*grams))


def margin(buckets: Column, weights: list[float]) -> Column:
    """Log-odds of a block: the intercept and the weights of the buckets, each once."""
    w = F.from_json(F.lit("[" + ",".join(repr(x) if x else "0" for x in weights) + "]"), "array<double>")
    return F.aggregate(buckets, F.lit(weights[-1]), lambda a, b: a + F.get(w, b))


def sigmoid(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", n_buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES, ridge: float = 3e-4, rounds: int = 30, tolerance: float = 1e-5) -> Model:
    """Weights that minimise the mean logistic loss plus ``ridge`` / 2 times their squared length, by L-BFGS.

    Each round is one aggregate by bucket over the labelled table; weights and gradient have the fixed length ``n_buckets`` + 1.
    """
    url = F.col(url_col)
    rows = labelled.where(url.isNotNull() & F.col(label_col).isNotNull()).limit(MAX_LABELLED + 1)
    rows = pinned(rows.select(F.col(label_col).cast("double").alias("y"), buckets_of(host_of(url), path_of(url), n_buckets, sizes).alias("b")).coalesce(4))
    n, ones = rows.agg(F.count("y"), F.sum("y")).first()
    if n > MAX_LABELLED:
        raise ValueError(f"a labelled table may have {MAX_LABELLED} rows; sample it")
    if not n or ones in (0, n):
        raise ValueError("the labelled table must have rows of both classes")

    def gradient(w: np.ndarray) -> np.ndarray:
        e = rows.select((sigmoid(margin(F.col("b"), w.tolist())) - F.col("y")).alias("e"), "b")
        each = e.select("e", F.explode(F.concat("b", F.array(F.lit(n_buckets)))).alias("i"))
        g = np.zeros(n_buckets + 1)
        for i, total in each.groupBy("i").agg(F.sum("e")).collect():
            g[i] = total / n
        g[:-1] += ridge * w[:-1]
        return g

    w = np.zeros(n_buckets + 1)
    w[-1] = math.log(ones / (n - ones))
    g, steps = gradient(w), []
    for _ in range(rounds):
        if np.abs(g).max() < tolerance:
            break
        d, back = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            back.append(a)
            d -= a * y
        d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 0.05
        for (s, y), a in zip(steps, reversed(back), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        after = w - d
        g_after = gradient(after)
        if (s := after - w) @ (y := g_after - g) > 1e-18:
            steps = [*steps[-7:], (s, y)]
        w, g = after, g_after
    return Model(w.tolist(), sizes)


def judge(df: DataFrame, model: Model, rules: list[tuple[str, str, str]] | None = None, url_col: str = "url", limit: float = 0.5) -> DataFrame:
    """The rows with host, path, rule, verdict and the model's score (0 to 1, higher: rather blocked) beside."""
    made = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in df.columns if c not in made]
    rows = df.select(*(F.col(f"`{c}`") for c in kept), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    score = sigmoid(margin(buckets_of(F.col("host"), F.col("path"), len(model.weights) - 1, model.sizes), model.weights))
    rule = rule_of(F.col("host"), F.col("path"), rules or [])
    by_model = F.when(score >= limit, "block").otherwise("allow")
    return rows.select(*(F.col(f"`{c}`") for c in kept), "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], by_model).alias("verdict"), score.alias("score"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark)), RULES).select("page_id", "host", "path", "rule", "verdict", "score")
