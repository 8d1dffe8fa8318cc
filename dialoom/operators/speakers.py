"""Speaker-label repair by voice vectors, votes and time.

Rows have clip columns, ``chunk_ord``, ``speaker`` and ``embedding`` (array<double>). Label-level tables (centroids, pairs
of labels) are small by nature: a clip has a few speakers. Kernels that need all vectors of a clip or label at once (greedy
and hierarchical clustering, two-means) run in one task for each clip or label, as the algorithms are sequential.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import centroids, cosine, dot, minus, sums, unit
from ..session import ship, written

BY = ("clip_id",)


def similarities(rows: DataFrame, by: Sequence[str] = BY, leave_out: bool = False) -> DataFrame:
    """rows joined to each label's centroid of its clip: ``label``, ``sim``. With leave_out, a row's own label leaves the row out.

    A label of one row has similarity 1 to itself then. The product is rows x labels of a clip, not rows x rows.
    """
    total = sums(rows, [*by, "speaker"]).select(*by, F.col("speaker").alias("label"), "total", "n")
    if not by:
        met = rows.crossJoin(F.broadcast(total)) if total.count() <= 10_000 else rows.crossJoin(total)
    else:
        met = rows.join(total, list(by))
    own = F.col("label") == F.col("speaker")
    if leave_out:
        rest = F.when(own, minus(F.col("total"), F.col("embedding"))).otherwise(F.col("total"))
        sim = F.when(own & (F.col("n") == 1), 1.0).otherwise(cosine(F.col("embedding"), rest))
    else:
        sim = cosine(F.col("embedding"), F.col("total"))
    return met.withColumn("sim", sim).drop("total", "n")


def best_label(rows: DataFrame, keys: Sequence[str], by: Sequence[str] = BY, leave_out: bool = False) -> DataFrame:
    """(by, keys, speaker, own_sim, best, best_sim, second_sim); of equal similarities the label that sorts first."""
    met = similarities(rows, by, leave_out)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col("label").alias("l"))))
    out = met.groupBy(*by, *keys, "speaker").agg(F.max(F.when(F.col("label") == F.col("speaker"), F.col("sim"))).alias("own_sim"), ranked.alias("r"))
    first, second = F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(2))
    return out.select(*by, *keys, "speaker", "own_sim", first.l.alias("best"), (-first.d).alias("best_sim"), (-second.d).alias("second_sim"))


def disagreements(rows: DataFrame, keys: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Rows whose nearest centroid is another label's."""
    return best_label(rows, keys, by).filter("best != speaker")


def confident_label(best: DataFrame, least: float, margin: float, fallback: Column) -> DataFrame:
    """best with ``label``: the best one if similar enough and ahead of the second by the margin, else the fallback."""
    sure = (F.col("best_sim") >= least) & (F.col("second_sim").isNull() | (F.col("best_sim") - F.col("second_sim") >= margin))
    return best.withColumn("label", F.when(sure, F.col("best")).otherwise(fallback))


def reassign(rows: DataFrame, keys: Sequence[str], margin: float, least: float, by: Sequence[str] = BY, passes: int = 3, leave_out: bool = True, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows move to the label whose centroid is better than their own by the margin, all at once in each pass; stops when none moves.

    ``cut`` may write each pass's rows to a table (cutting lineage) for many passes; three passes need none.
    """
    for _ in range(passes):
        best = best_label(rows, keys, by, leave_out)
        moved = best.filter((F.col("best") != F.col("speaker")) & (F.col("best_sim") > F.col("own_sim") + margin) & (F.col("best_sim") >= least))
        to = moved.select(*by, *keys, F.col("best").alias("_to"))
        if passes > 1 and to.isEmpty():
            break
        rows = rows.join(to, [*by, *keys], "left").withColumn("speaker", F.coalesce("_to", "speaker")).drop("_to")
        rows = cut(rows) if cut else rows
    return rows


def cohesion(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, cohesion): mean over labels, each counting alike, of the mean cosine of its rows to its centroid."""
    own = similarities(rows, by).filter("label = speaker")
    return own.groupBy(*by, "speaker").agg(F.avg("sim").alias("s")).groupBy(*by).agg(F.avg("s").alias("cohesion"))


def label_pairs(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, a, b, sim): cosines of the centroids of each two labels of a clip."""
    c = centroids(rows, [*by, "speaker"])
    a, b = (c.select(*by, F.col("speaker").alias(x), F.col("centroid").alias(f"c{x}")) for x in "ab")
    met = a.join(b, list(by)) if by else a.crossJoin(b)
    return met.filter("a < b").select(*by, "a", "b", dot(F.col("ca"), F.col("cb")).alias("sim"))


def pairwise_stats(rows: DataFrame, by: Sequence[str] = BY, low: float = 0.5) -> DataFrame:
    """(by, pairs, mean_sim, low_pairs) of the label pairs."""
    return label_pairs(rows, by).groupBy(*by).agg(F.count("*").alias("pairs"), F.avg("sim").alias("mean_sim"), F.count_if(F.col("sim") < low).alias("low_pairs"))


# Kernels: plain functions over the unit vectors of one clip or label.


def _units(vectors: Sequence) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def linkage(x: np.ndarray, threshold: float, kind: str) -> np.ndarray:
    """Agglomeration of unit vectors: the two most similar clusters merge while similarity >= threshold. kind: average or complete."""
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    size, label, alive = np.ones(len(x)), np.arange(len(x)), np.ones(len(x), bool)
    while alive.sum() > 1:
        a, b = divmod(int(sim.argmax()), len(x))
        if sim[a, b] < threshold:
            break
        a, b = min(a, b), max(a, b)
        joined = (size[a] * sim[a] + size[b] * sim[b]) / (size[a] + size[b]) if kind == "average" else np.minimum(sim[a], sim[b])
        joined[a] = -np.inf
        sim[a], sim[:, a] = joined, joined
        sim[b], sim[:, b] = -np.inf, -np.inf
        size[a] += size[b]
        alive[b] = False
        label[label == b] = a
    return label


def greedy(x: np.ndarray, threshold: float) -> np.ndarray:
    """Online clusters: each vector joins the most similar centroid so far if similar enough, which then moves; else begins a new one."""
    totals: list[np.ndarray] = []
    out = np.empty(len(x), int)
    for i, v in enumerate(x):
        sims = [float(v @ t) / max(float(np.linalg.norm(t)), 1e-12) for t in totals]
        best = int(np.argmax(sims)) if sims else -1
        if best >= 0 and sims[best] >= threshold:
            totals[best] = totals[best] + v
        else:
            totals.append(v.copy())
            best = len(totals) - 1
        out[i] = best
    return out


def two_means(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Cosine 2-means from the farthest pair; equally near vectors go to the first cluster."""
    if len(x) < 2:
        return np.zeros(len(x), int)
    a, b = divmod(int((x @ x.T).argmin()), len(x))
    centers = x[[a, b]]
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        sim = x @ centers.T
        own = (sim[:, 1] > sim[:, 0]).astype(int)
        if own.min() == own.max():
            break
        centers = np.stack([x[own == k].mean(axis=0) for k in (0, 1)])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return own


def silhouette(x: np.ndarray, own: np.ndarray) -> float:
    """Mean over vectors of (b - a) / max(a, b) of cosine distances; vectors alone in their cluster are left out."""
    away = 1 - x @ x.T
    found = []
    for i in range(len(x)):
        same = own == own[i]
        same[i] = False
        others = [away[i, own == k].mean() for k in np.unique(own) if k != own[i]]
        if same.any() and others:
            a, b = away[i, same].mean(), min(others)
            found.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(found)) if found else 0.0


def named(labels: np.ndarray, prefix: str) -> list[str]:
    """Labels numbered by their first place."""
    order = {k: i for i, k in enumerate(dict.fromkeys(labels.tolist()))}
    return [f"{prefix}{order[k]}" for k in labels.tolist()]


def cluster(rows: DataFrame, keys: Sequence[str], kernel: Callable[[np.ndarray], np.ndarray], prefix: str, by: Sequence[str] = BY, most: int | None = None) -> DataFrame:
    """(by, keys, cluster): a kernel over the vectors of each group of ``by``, in the order of keys.

    Rows of groups over ``most`` rows, whose kernel would need a matrix too large for a task, keep their ``speaker`` as cluster.
    """
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [*by, *keys]
    kept = None
    if most is not None:
        sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
        sized = rows.join(sizes, list(by))
        rows, kept = sized.filter(F.col("_n") <= most), sized.filter(F.col("_n") > most).select(*columns, F.col("speaker").alias("cluster"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(keys))
        return group[columns].assign(cluster=named(kernel(_units(group.embedding)), prefix))

    done = rows.select(*columns, "embedding").groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", cluster string")
    return done if kept is None else done.union(kept)


def recluster(rows: DataFrame, keys: Sequence[str], tau: float, by: Sequence[str] = BY, most: int = 2000) -> DataFrame:
    """Average-link clusters R0, R1... of each clip; one with over ``most`` rows keeps its speakers."""
    return cluster(rows, keys, lambda x: linkage(x, tau, "average"), "R", by, most)


def greedy_clusters(rows: DataFrame, keys: Sequence[str], threshold: float, by: Sequence[str] = BY) -> DataFrame:
    return cluster(rows, keys, lambda x: greedy(x, threshold), "C", by)


def merge_labels(rows: DataFrame, margin: float, floor: float, by: Sequence[str] = BY) -> DataFrame:
    """rows with labels of similar voices merged: complete link over the label centroids of a clip, at cohesion - margin or the floor.

    A merged label has the name of the one with most rows. Only centroids go to the kernel.
    """
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    c = centroids(rows, [*by, "speaker"]).join(cohesion(rows, by), list(by))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("speaker")
        own = linkage(_units(group.centroid), max(float(group.cohesion.iloc[0]) - margin, floor), "complete")
        group = group.assign(own=own)
        names = {k: g.sort_values(["n", "speaker"], ascending=[False, True]).speaker.iloc[0] for k, g in group.groupby("own")}
        return group[[*by, "speaker"]].assign(merged=[names[k] for k in own])

    to = c.groupBy(*by).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in by) + ", speaker string, merged string")
    return rows.join(to, [*by, "speaker"], "left").withColumn("speaker", F.coalesce("merged", "speaker")).drop("merged")


def split_labels(rows: DataFrame, keys: Sequence[str], least: int, margin: float, least_silhouette: float, pitch_gap: float = 70.0, by: Sequence[str] = BY) -> DataFrame:
    """rows with a label cut in two where two-means finds two voices: enough rows each, centroids less similar than the clip's cohesion
    minus the margin, a clear silhouette, and, where ``f0`` is known, medians of pitch far enough apart. The smaller part gets ``_s1``."""
    ship(rows.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [*by, *keys, "speaker"]
    joined = rows.select(*columns, "embedding", *(["f0"] if "f0" in rows.columns else [F.lit(None).cast("double").alias("f0")])).join(cohesion(rows, by), list(by))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(keys))
        x = _units(group.embedding)
        own = two_means(x)
        counts = np.bincount(own, minlength=2)
        out = group[columns].assign(split=group.speaker)
        if counts.min() >= least:
            centers = _units([x[own == k].mean(axis=0) for k in (0, 1)])
            pitch = [group.f0[own == k].dropna().median() if group.f0[own == k].notna().any() else np.nan for k in (0, 1)]
            apart = any(pd.isna(p) for p in pitch) or abs(pitch[0] - pitch[1]) >= pitch_gap
            if centers[0] @ centers[1] < float(group.cohesion.iloc[0]) - margin and silhouette(x, own) >= least_silhouette and apart:
                minor = 1 if counts[1] <= counts[0] else 0
                out["split"] = [f"{s}_s1" if k == minor else s for s, k in zip(group.speaker, own)]
        return out

    to = joined.groupBy(*by, "speaker").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", split string")
    return rows.join(to, columns).withColumn("speaker", F.col("split")).drop("split")


def silhouettes(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, keys..., a, b, silhouette) of each row, from sums alone: the mean distance to a label is 1 - x . sum / n."""
    x = rows.withColumn("embedding", unit(F.col("embedding"))).withColumn("_k", F.xxhash64(*[F.col(c) for c in rows.columns]))
    total = sums(x, [*by, "speaker"]).select(*by, F.col("speaker").alias("label"), "total", "n")
    met = x.join(total, list(by)) if by else x.crossJoin(total)
    near = dot(F.col("embedding"), F.col("total"))
    own = F.col("label") == F.col("speaker")
    away = F.when(own, 1 - (near - dot(F.col("embedding"), F.col("embedding"))) / (F.col("n") - 1)).otherwise(1 - near / F.col("n"))
    kept = met.filter(~own | (F.col("n") > 1)).withColumn("_d", away)
    keys = [c for c in rows.columns if c != "embedding"]
    out = kept.groupBy("_k", *keys).agg(F.max(F.when(own, F.col("_d"))).alias("a"), F.min(F.when(~own, F.col("_d"))).alias("b"))
    return out.filter("a IS NOT NULL AND b IS NOT NULL").withColumn("silhouette", F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)).drop("_k")


def absorb_singletons(rows: DataFrame, keys: Sequence[str], floor_short: float, floor_long: float, long_seconds: float, margin: float, by: Sequence[str] = BY) -> DataFrame:
    """A label with one row goes to the most similar label of several rows, from a floor by its duration and ahead of the second by the
    margin, else to the label that both neighbours share. Labels are those before the step."""
    count = F.count("*").over(Window.partitionBy(*by, "speaker"))
    sized = rows.withColumn("_n", count)
    anchors = centroids(sized.filter("_n > 1"), [*by, "speaker"]).select(*by, F.col("speaker").alias("label"), "centroid")
    alone = sized.filter("_n = 1").select(*by, *keys, "start", "end", "embedding")
    met = (alone.join(anchors, list(by)) if by else alone.crossJoin(anchors)).withColumn("sim", cosine(F.col("embedding"), F.col("centroid")))
    ranked = met.groupBy(*by, *keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col("label").alias("l")))).alias("r"))
    first, second = F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(2))
    ranked = ranked.select(*by, *keys, first.l.alias("_l"), (-first.d).alias("_s"), (-second.d).alias("_t"))
    w = Window.partitionBy(*by).orderBy("start", *keys)
    around = F.when(F.lag("speaker").over(w) == F.lead("speaker").over(w), F.lag("speaker").over(w))
    floor = F.when(F.col("end") - F.col("start") >= long_seconds, floor_long).otherwise(floor_short)
    sure = (F.col("_s") >= floor) & (F.col("_t").isNull() | (F.col("_s") - F.col("_t") >= margin))
    out = sized.withColumn("_around", around).join(ranked, [*by, *keys], "left")
    to = F.when(F.col("_n") == 1, F.coalesce(F.when(sure, F.col("_l")), F.col("_around")))
    return out.withColumn("speaker", F.coalesce(to, "speaker")).drop("_n", "_around", "_l", "_s", "_t")


def gender_split(rows: DataFrame, low: float, high: float, least: int = 2, by: Sequence[str] = BY) -> DataFrame:
    """A label with at least ``least`` rows of low and of high pitch (f0) is two speakers: the smaller part gets _gM or _gF."""
    w = Window.partitionBy(*by, "speaker")
    counted = rows.withColumn("_m", F.count_if(F.col("f0") <= low).over(w)).withColumn("_f", F.count_if(F.col("f0") >= high).over(w))
    both = (F.col("_m") >= least) & (F.col("_f") >= least)
    minor = F.when(F.col("_m") < F.col("_f"), F.when(F.col("f0") <= low, "_gM")).otherwise(F.when(F.col("f0") >= high, "_gF"))
    return counted.withColumn("speaker", F.concat("speaker", F.coalesce(F.when(both, minor), F.lit("")))).drop("_m", "_f")


def agreement(votes: DataFrame, keys: Sequence[str], voters: int, by: Sequence[str] = BY) -> DataFrame:
    """(by, a, b, share) of pairs of rows (a < b) that at least one voter puts together: votes (by, key, voter, label).

    A missing label agrees with nothing, but its voter counts. Pairs are made within (clip, voter, label) only.
    """
    key = keys[0]
    known = votes.filter("label IS NOT NULL")
    a, b = (known.select(*by, "voter", "label", F.col(key).alias(x)) for x in "ab")
    return a.join(b, [*by, "voter", "label"]).filter("a < b").groupBy(*by, "a", "b").agg((F.count("*") / voters).alias("share"))


def min_components(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = BY, most_rounds: int = 50) -> DataFrame:
    """(by, node, component): the smallest node reachable within the clip, by passing minima along edges and then along pointers."""
    both = edges.select(*by, F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(*by, F.col("b"), F.col("a"))).distinct()
    both = written(both, "component-edges")
    now = nodes.select(*by, "node", F.col("node").alias("component"))
    for _ in range(most_rounds):
        near = both.join(now.select(*by, F.col("node").alias("other"), F.col("component").alias("_c")), [*by, "other"]).groupBy(*by, "node").agg(F.min("_c").alias("_c"))
        stepped = now.join(near, [*by, "node"], "left").select(*by, "node", F.least("component", "_c").alias("component"), (F.col("_c") < F.col("component")).alias("_moved"))
        jump = stepped.select(*by, F.col("node").alias("component"), F.col("component").alias("_up"))
        after = stepped.join(jump, [*by, "component"], "left").select(*by, "node", F.least("component", "_up").alias("component"), "_moved")
        after = written(after, "component-round")
        now = after.drop("_moved")
        if after.filter("_moved").isEmpty():
            return now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def consensus(nodes: DataFrame, votes: DataFrame, keys: Sequence[str], voters: int, threshold: float, by: Sequence[str] = BY) -> DataFrame:
    """Rows put together by at least the threshold's share of voters are one speaker; so are chains of such rows.

    Rows with equal labels by all voters are one class: pairs are made of classes, which are few, not of rows. A class that fewer voters
    know than the threshold asks for has no links, not even among its own rows.
    """
    known = votes.filter("label IS NOT NULL").groupBy(*by, F.col(keys[0]).alias("node")).agg(F.array_sort(F.collect_set(F.struct("voter", "label"))).alias("labels"))
    known = written(known.filter(F.size("labels") / voters >= threshold), "label-tuples")
    classes = written(known.groupBy(*by, "labels").agg(F.min("node").alias("first")), "label-classes")
    ballots = classes.select(*by, F.col("first").alias(keys[0]), F.explode("labels").alias("v")).select(*by, keys[0], "v.voter", "v.label")
    edges = agreement(ballots, keys, voters, by).filter(F.col("share") >= threshold)
    joined = min_components(classes.select(*by, F.col("first").alias("node")), edges, by).withColumnRenamed("node", "first")
    of = known.join(classes, [*by, "labels"]).join(joined, [*by, "first"]).select(*by, "node", "component")
    every = nodes.select(*by, F.col(keys[0]).alias("node"))
    return every.join(of, [*by, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def dominant_of_cluster(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """(by, cluster, speaker, purity): counts (by, cluster, speaker, n) -> the most frequent speaker of each cluster and its share."""
    summed = counts.groupBy(*by, "cluster", "speaker").agg(F.sum("n").alias("n"))
    best = summed.groupBy(*by, "cluster").agg(F.max(F.struct("n", "speaker")).alias("m"), F.sum("n").alias("all"))
    return best.select(*by, "cluster", F.col("m.speaker").alias("speaker"), (F.col("m.n") / F.col("all")).alias("purity"))


def time_gap_parts(rows: DataFrame, gap: float = 5.0, by: Sequence[str] = BY) -> DataFrame:
    """rows with ``part``: a speaker's segments fall into parts where it is silent for at least ``gap`` seconds."""
    w = Window.partitionBy(*by, "speaker").orderBy("start", "chunk_ord")
    new = F.coalesce((F.col("start") - F.lag("end").over(w) >= gap).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("part", F.sum("_new").over(w)).drop("_new")


#: Repair modules by name: DataFrame in, DataFrame out. Callers may add their own.
MODULES: dict[str, Callable[..., DataFrame]] = {
    "embed_reassign": reassign, "embed_merge": merge_labels, "embed_split": split_labels, "singleton_absorb": absorb_singletons, "gender_split": gender_split,
}


def repair(rows: DataFrame, steps: Sequence[tuple[str, dict]]) -> DataFrame:
    """Applies named modules in order; an unknown name is an error before anything runs."""
    unknown = [name for name, _ in steps if name not in MODULES]
    if unknown:
        raise ValueError(f"unknown repair modules: {', '.join(unknown)}")
    for name, parameters in steps:
        rows = rows.transform(lambda d, f=MODULES[name], p=parameters: f(d, **p))
    return rows


def part_reassign(rows: DataFrame, gap: float, margin: float, by: Sequence[str] = BY) -> DataFrame:
    """Parts of a speaker between silences of at least ``gap`` seconds go to another speaker whose centroid fits the part's mean vector
    better, by the margin, than that of the speaker's other parts."""
    parts = time_gap_parts(rows, gap, by)
    part = sums(parts, [*by, "speaker", "part"]).select(*by, "speaker", "part", F.col("total").alias("v"), F.col("n").alias("k"))
    whole = sums(parts, [*by, "speaker"]).select(*by, F.col("speaker").alias("label"), "total", "n")
    met = part.join(whole, list(by)) if by else part.crossJoin(whole)
    own = F.col("label") == F.col("speaker")
    rest = F.when(own, minus(F.col("total"), F.col("v"))).otherwise(F.col("total"))
    sim = F.when(own & (F.col("n") == F.col("k")), F.lit(1.0)).otherwise(cosine(F.col("v"), rest))
    scored = met.withColumn("sim", sim).groupBy(*by, "speaker", "part").agg(
        F.max(F.when(own, F.col("sim"))).alias("own_sim"), F.max(F.when(~own, F.struct("sim", "label"))).alias("other"))
    moved = scored.filter(F.col("other.sim") > F.col("own_sim") + margin).select(*by, "speaker", "part", F.col("other.label").alias("_to"))
    return parts.join(moved, [*by, "speaker", "part"], "left").withColumn("speaker", F.coalesce("_to", "speaker")).drop("_to", "part")


def mint_by_faces(chunks: DataFrame, dominant: DataFrame, sims: DataFrame | None = None, veto: float = 0.6, by: Sequence[str] = BY) -> DataFrame:
    """A label whose chunks show two or more faces gives the chunks of its rarer faces new labels, unless the voices say otherwise:
    sims (by, chunk_ord, own_sim), where own_sim at or above the veto keeps a chunk."""
    met = chunks.join(dominant, [*by, "chunk_ord"], "left")
    counts = met.filter("face IS NOT NULL").groupBy(*by, "speaker", "face").agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "speaker").orderBy(F.desc("_n"), "face")))
    met = met.join(ranked.select(*by, "speaker", "face", "_r"), [*by, "speaker", "face"], "left")
    if sims is not None:
        met = met.join(sims.select(*by, "chunk_ord", F.col("own_sim").alias("_s")), [*by, "chunk_ord"], "left")
    else:
        met = met.withColumn("_s", F.lit(None).cast("double"))
    new = (F.col("_r") > 1) & (F.coalesce("_s", F.lit(0.0)) < veto)
    return met.withColumn("speaker", F.when(new, F.concat("speaker", F.lit("_m"), (F.col("_r") - 1).cast("string"))).otherwise(F.col("speaker"))).drop("_r", "_s")


def sub_split(rows: DataFrame, keys: Sequence[str], threshold: float, least: int = 3, by: Sequence[str] = BY) -> DataFrame:
    """Average-link clusters within each label; where at least two have ``least`` rows, all but the largest become _b, _c and so on."""
    own = cluster(rows, keys, lambda x: linkage(x, threshold, "average"), "K", [*by, "speaker"])
    sized = own.groupBy(*by, "speaker", "cluster").agg(F.count("*").alias("_n"), F.min(keys[0]).alias("_f"))
    big = sized.filter(F.col("_n") >= least).withColumn("_k", F.count("*").over(Window.partitionBy(*by, "speaker"))).filter("_k >= 2")
    ranked = big.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "speaker").orderBy(F.desc("_n"), "_f")))
    name = F.when(F.col("_r") > 1, F.concat("speaker", F.lit("_"), F.char(F.lit(96) + F.col("_r"))))
    to = own.join(ranked.select(*by, "speaker", "cluster", "_r"), [*by, "speaker", "cluster"], "left").select(*by, *keys, name.alias("_to"))
    return rows.join(to, [*by, *keys], "left").withColumn("speaker", F.coalesce("_to", "speaker")).drop("_to")


MODULES |= {"part_reassign": part_reassign, "face_mint": mint_by_faces, "sub_split": sub_split}
