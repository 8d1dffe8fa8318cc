"""Language ID: nearest centroid over normalised TF-IDF vectors of letter n-grams.

Texts are lower-cased, every run of non-letters becomes one space, and all n-grams of 1 to 3 characters of
the whole text are hashed into ``DIMENSIONS`` features (log frequency x IDF, unit length). Each language has
several centroids, found by spherical k-means within the language. The language of a text is that of the
centroid with the largest cosine; the cosine, clipped to 0..1, is the score.

Rejection by distance: for each language and length class (powers of two of the number of letters) the
limit is a share of the low similarities that the training texts, and their own beginnings of that length, have to
their centroid. Junk among the labelled rows is left out of the limits: a text whose similarity at some length from
``2 ** CERTAIN`` on lies over ``FAR`` deviations (1.4826 x the median deviation) below the median counts neither there nor at
greater lengths. Classes above the longest one that a text reaches have that class's limit. A text below its limit is
rejected: it is unlike everything learned.

Bounds: at most about ``MAX_TEXTS`` labelled texts of each language are learned from, spread over the corpus by
a hash of doc_id (a documented bound on the fit alone; every text is classified, and whole). The model
is languages x ``CLUSTERS`` x ``DIMENSIONS`` floats, some hundred KB, and travels with the tasks.

Defined cases: null text or text without a letter gives ``und`` with score 0, rejected. Equal cosines go to
the language that sorts first. A language none of whose texts has a letter is not learned. Very long texts are
counted whole. An empty table gives an empty table. Rows without lang or doc_id are never learned from, but classified. No labelled
row at all: everything is ``und``. Repeated rows get equal answers; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import free_name, written

DIMENSIONS = 4096
CLUSTERS = 3
MAX_TEXTS = 600
#: A text is rejected below this share of the low similarities seen in training at its length.
REJECT_SHARE = 0.6
FAR = 3.0
CERTAIN = 5
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Feature numbers of all n-grams of the text, and its number of letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(codes)
    n = int(letter.sum())
    if not n:
        return np.empty(0, np.int64), 0
    line = np.concatenate(([32], np.where(letter, codes, 32), [32])).astype(np.uint64)
    space = line == 32
    line = line[~(space & np.concatenate(([False], space[:-1])))]
    single = line * np.uint64(0x9E3779B97F4A7C15)
    double = single[:-1] * np.uint64(3) + line[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    triple = double[:-1] * np.uint64(5) + line[2:] * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    return np.concatenate([(x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift for x in (single, double, triple)]).astype(np.int64), n


def _vectors(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Log frequencies, a row for each text, and the numbers of letters."""
    rows, letters = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found, letters[i] = features(text)
        rows[i] = np.log1p(np.bincount(found, minlength=DIMENSIONS))
    return rows, letters


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), 15)


def _cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; seeds are the first row and then the farthest from those before."""
    seeds = [0]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int(np.argmin((rows @ rows[seeds].T).max(axis=1))))
    centers = rows[seeds]
    for _ in range(10):
        own = (rows @ centers.T).argmax(axis=1)
        centers = _unit(np.stack([rows[own == c].sum(axis=0) if (own == c).any() else centers[c] for c in range(len(centers))]))
    return centers


def _limits(texts: list[str], idf: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The limit of each length class."""
    low, junk = np.full(16, np.nan), np.zeros(len(texts), bool)
    for c in range(16):
        reach = np.array([i for i, t in enumerate(texts) if len(t) >= 2**c], np.int64)
        own, n = _vectors([texts[i][: int(1.5 * 2**c)] if c < 15 else texts[i] for i in reach])
        reach, own = reach[n > 0], own[n > 0]
        if not len(reach):
            continue
        near = (_unit(own * idf) @ centers.T).max(axis=1)
        usual = near[~junk[reach]]
        if not len(usual):
            continue
        middle = np.median(usual)
        far = near < middle - FAR * 1.4826 * np.median(np.abs(usual - middle)) - 1e-6
        low[c] = np.quantile(near[~far & ~junk[reach]], 0.01) * REJECT_SHARE
        if c >= CERTAIN:
            junk[reach[far]] = True
    limits, last = np.zeros(16), np.inf
    for c in range(15, -1, -1):  # no class has a higher limit than a longer one; a class that no text reaches takes the next longer one's
        last = last if np.isnan(low[c]) else min(last, low[c])
        limits[c] = last
    reached = limits[np.isfinite(limits)]
    return np.where(np.isfinite(limits), limits, reached[-1] if len(reached) else 0.0)


_MODEL = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("centroids", T.ArrayType(T.ArrayType(T.FloatType()))),
    T.StructField("limits", T.ArrayType(T.DoubleType())),
])


class LanguageModel:
    """Centroids and limits of each language, with the IDF of the features."""

    def __init__(self, idf: np.ndarray, languages: list[tuple[str, np.ndarray, np.ndarray]]):
        self.idf = idf
        self.languages = sorted(languages, key=lambda x: x[0])
        self.names = [name for name, _, _ in self.languages]
        self.centers = np.concatenate([c for _, c, _ in self.languages]) if languages else np.empty((0, DIMENSIONS), np.float32)
        self.owner = np.repeat(np.arange(len(languages)), [len(c) for _, c, _ in self.languages]) if languages else np.empty(0, int)
        self.limits = np.stack([x for _, _, x in self.languages]) if languages else np.empty((0, 16))

    def classify(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, rejections."""
        rows, letters = _vectors(texts)
        known = (letters > 0) & (len(self.names) > 0)
        if not len(self.names):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        near = _unit(rows * self.idf) @ self.centers.T
        best = near.argmax(axis=1)
        own, score = self.owner[best], np.clip(near[np.arange(len(texts)), best].astype(float), 0, 1)
        rejected = ~known | (score < self.limits[own, length_class(letters)])
        return [self.names[o] if k else UNKNOWN for o, k in zip(own, known)], np.where(known, score, 0.0), rejected


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_texts: int = MAX_TEXTS, clusters: int = CLUSTERS) -> LanguageModel:
    """Fits the model on labelled rows. The statistics and clusters are computed on the executors."""
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).cast("string").alias("key")).filter(
        "text IS NOT NULL AND lang IS NOT NULL AND key IS NOT NULL"
    )
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, max_texts / n)))]) if counts else None
    if share is None:
        return LanguageModel(np.ones(DIMENSIONS, np.float32), [])
    drawn = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / float(1 << 20)
    sample = written(rows.filter(drawn < share[F.col("lang")]).select("text", "lang", "key"), "language-sample")

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMENSIONS), 0
        for batch in batches:
            for part in np.array_split(np.arange(len(batch)), -(-len(batch) // 64)):
                found, _ = _vectors(batch.text.iloc[part].tolist())
                total += (found > 0).sum(axis=0)
                n += len(part)
        if n:
            yield pd.DataFrame({"feature": np.arange(-1, DIMENSIONS), "n": np.concatenate(([n], total))})

    seen = {r.feature: r.n for r in sample.mapInPandas(presence, "feature long, n double").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    texts = seen.get(-1, 0)
    idf = np.array([np.log((1 + texts) / (1 + seen.get(f, 0))) + 1 for f in range(DIMENSIONS)], np.float32)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        plain, letters = _vectors(group.text.tolist())
        rows = _unit(plain * idf)[letters > 0]
        if not len(rows):
            return pd.DataFrame({"lang": [], "centroids": [], "limits": []}, dtype=object)  # a language without a letter has no centroid
        centers = _cluster(rows, clusters)
        limits = _limits(group.text.tolist(), idf, centers)
        return pd.DataFrame({"lang": [group.lang.iloc[0]], "centroids": [centers.tolist()], "limits": [limits.tolist()]})

    model = sample.groupBy("lang").applyInPandas(fit, _MODEL).collect()  # bounded: languages x clusters x dimensions
    return LanguageModel(idf, [(r.lang, np.array(r.centroids, np.float32), np.array(r.limits)) for r in model])


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score`` and ``rejected`` (taken over if docs has them)."""

    ship(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        names, scores, rejected = [], [], []
        for at in range(0, len(texts), 64):
            n, s, r = model.classify(texts.iloc[at : at + 64].tolist())
            names, scores, rejected = names + n, scores + s.tolist(), rejected + r.tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejected})

    answer = free_name(docs, "_answer")
    found = docs.withColumn(answer, classify(F.col(text)))
    for name in ("lang_pred", "score", "rejected"):
        found = found.withColumn(name, F.col(f"{answer}.{name}"))
    return found.drop(answer)


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
