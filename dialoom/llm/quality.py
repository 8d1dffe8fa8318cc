"""Quality rules: counts, fixed base rules, and robust multivariate outliers.

Each text gives a vector of transformed statistics (logs of sizes and smoothed shares, so that clean texts of any length are near a
normal cloud). For each language and source the minimum covariance determinant estimates where the regular texts
lie: over the h = ``CORE`` share of rows with the smallest distances the mean and covariance are those of least
determinant. A text whose squared Mahalanobis distance is beyond the limit is an outlier and is not kept.

Estimates are made at three levels, for each language and source, each language, and the corpus, and each is shrunk towards the one
above it with the weight n / (n + ``PRIOR_ROWS``), n being the group's rows; the corpus's towards variances of ``PRIOR_VARIANCE``
around its own mean. So each group is judged by an estimate of its own from its first row on, and there is no least size.

The estimate runs as Spark jobs, over all rows and all groups of all levels at once: hash parts of at most about ``PART_ROWS``
rows of a group each run C-steps from random starts in their own task and give their best estimate; the one with the least
determinant starts the group's own C-steps, in each of which all rows get their distances, the h-quantile of these bounds the core,
and sums of products over the core (partial sums in each task) give the next mean and covariance, until no group's
log determinant moves by more than ``SETTLED``, or ``MOST_STEPS`` steps are done. No group is ever in one task. Estimates stay
in tables with a row for each group and a task for each ``TASK_GROUPS`` of them; nothing but the numbers of groups and of unsettled
ones reaches the driver.

The limit for squared distances is the chi-square quantile at ``TAIL_SIGMAS``, times the factor that makes the group's median
squared distance that of chi-square (shrunk like the estimate), times ``SLACK`` squared, since text statistics have longer tails
than a normal cloud.

Defined cases: null text has no words and fails the base rules; null language or source is a group like others; a group without
regular texts is judged by the level above it, and without any regular text the distance is null; repeated rows get equal
answers; equal distances are all within the core or all beyond; of equal determinants the first part counts; a statistic that does
not vary gets a small variance so that distances stay defined; very long texts are one row's work, linear in their words; an
empty table gives an empty one. ``assess`` returns its own columns only, so extra columns go and no name clashes;
``count_statistics`` lets them pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import free_name, written

CORE = 0.75
PART_ROWS = 1_000
PRIOR_ROWS = 100
PRIOR_VARIANCE = 1.0
SETTLED = 0.01
MOST_STEPS = 12
#: Rows of tables with a row for each group that a task writes.
TASK_GROUPS = 10_000
#: Added to each variance: differences of a tenth in a logarithm mean nothing.
LEAST_VARIANCE = 0.01
TAIL_SIGMAS = 3.7
SLACK = 3.0
MIN_WORDS = 50
MOST_REPEATED = 50
_SYMBOLS = b"#*$%&|<>"
_BREAKS = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
#: ASCII characters in words that are no letters.
_OTHERS = bytes(c for c in range(128) if not chr(c).isalpha() and c not in _BREAKS)
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_others", "n_upper", "n_types", "n_lines")
#: Number of transformed statistics.
SIZE = 7


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of the names above."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at exactly the ASCII white space
    less = lambda some: len(raw) - len(raw.translate(None, some))
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            until = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, until)
                    until = i + 3
    chars = len(text or "") - less(_BREAKS)
    return n, chars, less(_SYMBOLS), n_dup, repeated, less(_OTHERS), less(_UPPER), len(set(words)), len(lines)


def _transformed(rows: pd.DataFrame) -> np.ndarray:
    """Vectors of a batch of counts: logs of sizes and of shares. A share is smoothed by what any clean text may show."""
    c = {k: rows[k].to_numpy(float) for k in _NAMES}
    share = lambda part, whole, usual: np.log((c[part] + usual * c[whole] + 1) / (c[whole] + 1 / usual) / usual)
    n, chars = c["n_words"], c["word_chars"]
    return np.stack([
        np.log(n + 1), np.log((chars + 1) / (n + 1)), share("n_symbols", "word_chars", 0.05), share("n_repeat_words", "n_words", 0.2),
        share("n_others", "word_chars", 0.05), share("n_upper", "word_chars", 0.05), np.log((c["n_types"] + 1) / (n + 1) ** 0.8),
    ], axis=1)


def _estimate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    return mean, np.cov(x, rowvar=False, bias=True) + np.diag(np.full(SIZE, LEAST_VARIANCE))


def _distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d)


def minimum_determinant(x: np.ndarray, starts: int = 8, steps: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, covariance and log determinant of the best core of one part: C-steps from random small subsets."""
    h = max(int(CORE * len(x)), min(len(x), SIZE + 1))
    draw, best = np.random.default_rng(seed), None
    for _ in range(starts):
        own = x[draw.choice(len(x), min(len(x), 2 * SIZE), replace=False)]
        mean, cov = _estimate(own)
        for _ in range(steps):
            mean, cov = _estimate(x[np.argpartition(_distances(x, mean, cov), h - 1)[:h]])
        size = np.linalg.slogdet(cov)[1]
        if best is None or size < best[2]:
            best = mean, cov, size
    return best


def chi_square_quantile(sigmas: float, size: int) -> float:
    """Wilson and Hilferty's approximation of the quantile that lies so many standard normal deviations out."""
    return size * (1 - 2 / (9 * size) + sigmas * np.sqrt(2 / (9 * size))) ** 3


def count_statistics(docs: DataFrame) -> DataFrame:
    """docs with the counts and ``stats``, the transformed vector; in one pass over the texts."""

    ship(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{k} long" for k in _NAMES) + ", stats array<double>")
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([statistics(t) for t in texts], columns=list(_NAMES))
        return rows.assign(stats=list(_transformed(rows)) if len(rows) else [])

    answer = free_name(docs, "_answer")
    out = docs.withColumn(answer, count(F.col("text")))
    for name in (*_NAMES, "stats"):
        out = out.withColumn(name, F.col(f"{answer}.{name}"))
    return out.drop(answer)


_PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
_GROUP = "level int, lang string, source string"
_ESTIMATE = f"{_GROUP}, n long, before double, logdet double, mean array<double>, cov array<double>, inverse array<double>"
_KEYS = ["level", "lang", "source"]


def _same_group(left: DataFrame, right: DataFrame, level: Column | None = None) -> Column:
    """Null-safe equality of groups; a level leaves out what it does not tell apart."""
    level = left["level"] if level is None else level
    return (level == right["level"]) & left["lang"].eqNullSafe(right["lang"]) & left["source"].eqNullSafe(right["source"])


def _of_level(level: Column) -> list[Column]:
    """Level, language and source of a row's group at a level: 0 the corpus, 1 its language, 2 its language and source."""
    return [level.alias("level"), F.when(level >= 1, F.col("lang")).alias("lang"), F.when(level >= 2, F.col("source")).alias("source")]


def _gathered(df: DataFrame, groups: int) -> DataFrame:
    """Rows for each group in as few partitions as they need, however many their shuffle had."""
    return df.repartition(max(1, -(-groups // TASK_GROUPS)))


def _distance(stats: Column, mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance in plain arithmetic; inverse: the upper triangle, row by row."""
    d = [F.get(stats, F.lit(i)) - F.get(mean, F.lit(i)) for i in range(SIZE)]
    terms = [F.get(inverse, F.lit(k)) * d[i] * d[j] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def _upper_inverse(cov: np.ndarray) -> np.ndarray:
    """The upper triangle of a covariance's inverse, row by row."""
    return np.linalg.inv(np.reshape(cov, (SIZE, SIZE)))[np.triu_indices(SIZE)]


def _inverted(estimates: DataFrame) -> DataFrame:
    """estimates with ``inverse`` of their covariances."""

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(inverse=[_upper_inverse(c) for c in batch["cov"]])

    return estimates.drop("inverse").mapInPandas(invert, _ESTIMATE)


def _first_estimates(dealt: DataFrame) -> DataFrame:
    """Of rows (level, lang, source, part, stats), the estimate of each group's part with the least determinant."""

    def start(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part.stats.to_numpy())
        mean, cov, size = minimum_determinant(x[np.lexsort(x.T)])
        return part[[*_KEYS, "part"]].head(1).assign(n=len(x), logdet=size, mean=[mean], cov=[cov.ravel()], inverse=[_upper_inverse(cov)])

    parts = dealt.groupBy(*_KEYS, "part").applyInPandas(start, f"{_GROUP}, part int, n long, logdet double, mean array<double>, cov array<double>, inverse array<double>")
    best = F.min(F.struct("logdet", "part", "mean", "cov", "inverse"))
    first = parts.groupBy(*_KEYS).agg(F.sum("n").alias("n"), best.alias("e"))
    return first.select(*_KEYS, "n", F.lit(None).cast("double").alias("before"), "e.logdet", "e.mean", "e.cov", "e.inverse")


def _with_distance(dealt: DataFrame, estimates: DataFrame) -> DataFrame:
    joined = dealt.join(estimates, _same_group(dealt, estimates)).select(*[dealt[k] for k in _KEYS], "stats", "n", "logdet", "mean", "inverse")
    return joined.select(*_KEYS, "stats", "n", "logdet", _distance(F.col("stats"), F.col("mean"), F.col("inverse")).alias("distance"))


def _step(dealt: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """Estimates of the cores that lie nearest by the given estimates; ``before``: the given log determinants."""
    measured = _with_distance(dealt, estimates)
    bounds = measured.groupBy(*_KEYS).agg(F.percentile_approx("distance", F.lit(CORE), F.lit(2000)).alias("bound"))
    bounds = written(_gathered(bounds, groups), "quality-bounds")
    core = measured.join(bounds, _same_group(measured, bounds)).filter("distance <= bound")
    core = core.select(*[measured[k] for k in _KEYS], "stats", "n", "logdet")
    at = [F.get("stats", F.lit(i)) for i in range(SIZE)]
    sums = core.groupBy(*_KEYS).agg(
        F.first("n").alias("n"), F.first("logdet").alias("before"), F.count("*").alias("rows"), *[F.sum(a).alias(f"s{i}") for i, a in enumerate(at)],
        *[F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i, j in _PAIRS],
    )

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            means, covs, sizes, inverses = [], [], [], []
            for row in batch.itertuples():
                mean = np.array([getattr(row, f"s{i}") for i in range(SIZE)]) / row.rows
                cov = np.empty((SIZE, SIZE))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = getattr(row, f"p{i}_{j}") / row.rows - mean[i] * mean[j]
                cov += np.diag(np.full(SIZE, LEAST_VARIANCE))
                means.append(mean)
                covs.append(cov.ravel())
                sizes.append(np.linalg.slogdet(cov)[1])
                inverses.append(_upper_inverse(cov))
            yield batch[[*_KEYS, "n", "before"]].assign(logdet=sizes, mean=means, cov=covs, inverse=inverses)

    return written(_gathered(sums, groups).mapInPandas(estimate, _ESTIMATE), "quality-estimates")


def _shrunk(own: Column, above: Column) -> Column:
    weight = F.col("n") / (F.col("n") + F.lit(PRIOR_ROWS))
    return weight * own + (1 - weight) * above


def _levelled(estimates: DataFrame, names: list[str]) -> DataFrame:
    """estimates with the arrays so named shrunk towards those of the level above, from the corpus downwards."""
    prior = {"mean": F.col("mean"), "cov": F.array(*[F.lit(PRIOR_VARIANCE if i == j else 0.0) for i in range(SIZE) for j in range(SIZE)])}
    mix = lambda own, above: F.zip_with(own, above, _shrunk)
    done = estimates.filter("level = 0").withColumns({x: mix(F.col(x), prior[x]) if x in prior else F.col(x) for x in names})
    levels = [done]
    for level in (1, 2):
        over = done.select("lang", *[F.col(x).alias(f"above_{x}") for x in names]).withColumnRenamed("lang", "above_lang")
        own = estimates.filter(F.col("level") == level)
        met = own.join(over, F.when(F.lit(level == 2), own.lang).eqNullSafe(over.above_lang))
        done = met.withColumns({x: mix(F.col(x), F.col(f"above_{x}")) for x in names}).select(*estimates.columns)
        levels.append(done)
    return levels[0].union(levels[1]).union(levels[2])


def robust_estimates(regular: DataFrame) -> DataFrame:
    """Of rows (lang, source, hash, stats): (level, lang, source, n, mean, cov, inverse, limit) of the groups of all levels, shrunk."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("level")
    every = regular.select("hash", "stats", "lang", "source", levels).select(*_of_level(F.col("level")), "hash", "stats")
    counts = written(every.groupBy(*_KEYS).agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).alias("parts")), "quality-groups")
    dealt = every.join(counts, _same_group(every, counts)).select(*[every[k] for k in _KEYS], F.pmod("hash", "parts").cast("int").alias("part"), "stats")
    dealt = written(dealt, "quality-rows")
    groups = counts.count()
    now = written(_gathered(_first_estimates(dealt), groups), "quality-estimates")
    for _ in range(MOST_STEPS):
        now = _step(dealt, now, groups)
        if not now.filter(F.abs(F.col("logdet") - F.col("before")) > SETTLED).count():
            break
    now = written(_inverted(_gathered(_levelled(now, ["mean", "cov"]), groups)), "quality-estimates")
    middle = F.array(F.percentile_approx("distance", F.lit(0.5), F.lit(2000)))
    medians = _with_distance(dealt, now).groupBy(*_KEYS).agg(F.first("n").alias("n"), middle.alias("middle"))
    medians = written(_gathered(medians, groups), "quality-medians")
    medians = _levelled(medians, ["middle"]).select(*_KEYS, F.get("middle", F.lit(0)).alias("middle"))
    factor = F.greatest(F.col("middle") / F.lit(float(chi_square_quantile(0, SIZE))), F.lit(1e-9))
    held = now
    limit = (float(chi_square_quantile(TAIL_SIGMAS, SIZE)) * SLACK**2 * factor).alias("limit")
    return held.join(medians, _same_group(held, medians)).select(*[held[k] for k in _KEYS], held["n"], "mean", "cov", "inverse", limit)


def assess(docs: DataFrame, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """(doc_id, counts, base_failed, distance, kept) of docs with doc_id, text, lang and source; distance: 1 is the limit."""
    own = docs.select("doc_id", "text", "lang", "source")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    counted = count_statistics(own).drop("text").withColumn("base_failed", failed)
    counted = written(counted.withColumn("hash", F.xxhash64("doc_id", "stats")), "quality-counts")
    estimates = robust_estimates(counted.filter(~F.col("base_failed")).select("lang", "source", "hash", "stats"))
    estimates = written(estimates.select(*_KEYS, "mean", "inverse", "limit"), "quality-limits")
    judged = counted
    for level in (2, 1, 0):
        held = estimates.filter(F.col("level") == level).select(
            F.col("lang").alias("held_lang"), F.col("source").alias("held_source"), F.struct("mean", "inverse", "limit").alias(f"level_{level}")
        )
        lang, source = F.when(F.lit(level >= 1), judged["lang"]), F.when(F.lit(level >= 2), judged["source"])
        met = lang.eqNullSafe(held["held_lang"]) & source.eqNullSafe(held["held_source"])
        judged = judged.join(held, met, "left").drop("held_lang", "held_source")
    nearest = F.coalesce("level_2", "level_1", "level_0")
    judged = judged.withColumn("level_0", nearest)
    share = _distance(F.col("stats"), F.col("level_0.mean"), F.col("level_0.inverse")) / F.col("level_0.limit")
    judged = judged.withColumn("distance", share)
    kept = (~F.col("base_failed") & ~(F.coalesce("distance", F.lit(0.0)) > 1)).alias("kept")
    return judged.select("doc_id", *_NAMES, "base_failed", "distance", kept)
