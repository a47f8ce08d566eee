"""Language identification by hierarchical discrimination.

First one-versus-rest linear support vector machines name the language family; then, within it, one-versus-one
linear support vector machines vote among its languages. Features are hashed byte n-grams of the letters.

The models are fitted on a bounded sample (``max_rows`` rows in all, shared evenly by the languages; those with the
smallest hash of their id), never on the held-out fold, and only on text and language.

Defined results: a null or empty text or one without a letter is "und" with score 0; a very long text is read whole; equal
votes go to the greater code, equal margins to the first family; of rows of equal hash the lesser id is sampled first; without any learned language every text
is "und" with score 0; with one language, all are that one; repeated rows give repeated results; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, map_rows, pinned, read

FOLDS, FOLD = 4, 2
DIMENSIONS = 4096
LETTER = regex.compile(r"\p{L}")

#: A family that isn't listed takes so many languages at most, each this alike (cosine of mean vectors) to its first.
FAMILY_SIZE = 16
ALIKE = 0.7

# Language families by code. Languages that aren't listed find their families by likeness.
FAMILIES = {
    "germanic": "en de nl af da sv no nb nn is fy lb yi",
    "romance": "es fr it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr ne pa gu",
    "sinitic": "zh yue wuu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# ASCII letters in lower case, other ASCII as a space, bytes of other characters as they are.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte bigrams and trigrams: a vector of length 1."""
    raw = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(DIMENSIONS)
    if len(b) > 2:
        two = b[:-1] * np.uint32(257) + b[1:]
        three = (two[:-1] * np.uint32(257) + b[2:]) * np.uint32(2654435761)
        two = two * np.uint32(2246822519)
        out += np.bincount(np.concatenate([two, three]) >> np.uint32(32 - 12), minlength=DIMENSIONS)
        out = np.sqrt(out / out.sum())
    return out.astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 200) -> np.ndarray:
    """Linear machine with squared hinge loss by accelerated gradient; y is +1 or -1, the last weight is the bias. Classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    w = np.zeros(x.shape[1] + 1, np.float32)
    z, step, t = w.copy(), 1.0 / (1.0 + 4.0 * c), 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1])) * weight
        g = -2 * y * slack
        new = z - step * np.append(x.T @ g + z[:-1], g.sum() + 1e-3 * z[-1]).astype(np.float32)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + ((t - 1) / t2) * (new - w), new, t2
    return w


@dataclass
class Hierarchy:
    """families: their names; family_w: one machine each; pairs: family -> [(language a, language b, machine)]."""

    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[str, str, np.ndarray]]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.families:
            return "und", 0.0
        margin = self.family_w[:, :-1] @ x + self.family_w[:, -1]
        share = np.exp(3 * (margin - margin.max()))
        share /= share.sum()
        k = int(margin.argmax())
        family, sure = self.families[k], float(share[k])
        votes = {lang: 0.0 for lang in self.languages[family]}
        for a, b, w in self.pairs[family]:
            p = float(1 / (1 + np.exp(-np.clip(3 * (w[:-1] @ x + w[-1]), -60, 60))))
            votes[a] += p
            votes[b] += 1 - p
        best = max(votes, key=lambda lang: (votes[lang], lang))
        if len(votes) > 1:
            sure *= votes[best] / (len(votes) - 1)
        return best, min(max(sure, 0.0), 1.0)


def families(x: np.ndarray, lang: np.ndarray) -> dict[str, str]:
    """language -> family: by the code without region; other languages, in order of code, join the family of the first that they are like enough."""
    out, first = {}, []
    for code in sorted(set(lang)):
        if known := FAMILY_OF.get(code.replace("_", "-").split("-")[0].lower()):
            out[code] = known
            continue
        mean = x[lang == code].mean(0)
        mean /= np.linalg.norm(mean) or 1
        for leader in first:
            if leader[1] @ mean >= ALIKE and leader[2] < FAMILY_SIZE:
                leader[2] += 1
                out[code] = leader[0]
                break
        else:
            out[code] = f"like {code}"
            first.append([out[code], mean, 1])
    return out


def fit(x: np.ndarray, langs: list[str]) -> Hierarchy:
    if not langs:
        return Hierarchy()
    lang = np.array(langs)
    of = families(x, lang)
    family = np.array([of[code] for code in langs])
    names = sorted(set(family))
    family_w = np.stack([svm(x, np.where(family == f, 1.0, -1.0).astype(np.float32)) for f in names])
    languages = {f: sorted(set(lang[family == f])) for f in names}
    pairs = {}
    for f in names:
        pairs[f] = []
        for a, b in combinations(languages[f], 2):
            mine = (lang == a) | (lang == b)
            pairs[f].append((a, b, svm(x[mine], np.where(lang[mine] == a, 1.0, -1.0).astype(np.float32))))
    return Hierarchy(names, family_w, languages, pairs)


def train(docs: DataFrame, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy:
    """Three scans, whatever the number of languages: one counts them, one picks the ids of the sample, one makes its vectors.

    Ids are picked by the hash of each: first those under a bound that lets a few more than wanted through, then the least
    of these, so that no task sees more of a language than the sample. About ``max_rows`` rows reach the driver, each as
    one vector: an even share of each language, one row at least.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, FOLDS, FOLD))
    usable = usable.where(F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    counts = usable.groupBy("_lang").count().collect()
    if not counts:
        return Hierarchy()
    each = max(1, max_rows // len(counts))
    enough = each + 10 * each**0.5 + 10  # ten standard deviations more than wanted
    bound = docs.sparkSession.createDataFrame([(r["_lang"], min(1 << 30, int((1 << 30) * enough / r["count"]) + 1)) for r in counts], "_of string, _bound long")
    salt = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    near = usable.select("_lang", "_id", salt.alias("_salt")).join(F.broadcast(bound), F.col("_lang") == F.col("_of")).where(F.col("_salt") < F.col("_bound"))
    ranked = pinned(near.select("_lang", "_id", F.row_number().over(Window.partitionBy("_lang").orderBy("_salt", "_id")).alias("_rank")))
    chosen = ranked.where(F.col("_rank") <= each).select(F.col("_id").alias("_chosen")).distinct()
    sample = usable.join(F.broadcast(chosen), F.col("_id") == F.col("_chosen"), "left_semi")
    got = map_rows(sample.select(F.col("_id").cast("string"), "_lang", "_text"), lambda c: [c[0], c[1], [features(t).tobytes() for t in c[2]]], "id string, lang string, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["lang"], r["x"]))
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in got]), [r["lang"] for r in got])


def identify_language(docs: DataFrame, model: Hierarchy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score: one map over the texts; the model's size is fixed by the number of languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(model, columns):
        said = [model.predict(features(t)) if t and LETTER.search(t) else ("und", 0.0) for t in columns[1]]
        return [columns[0], [s[0] for s in said], pa.array([s[1] for s in said], pa.float64())]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), each, f"`{id_col}` {kind}, lang_pred string, score double", lambda: shared.value)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify_language(docs, train(docs)).select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "lang_pred", "score")
