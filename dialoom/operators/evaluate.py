"""Hand-written expectations against a labelling: role mapping, pass or fail of each, identity scores, sweeps.

Expectations (id, kind, start, end, weight, role, roles) of kind single_role, ordered_roles or non_asr. They are written by
hand, some dozens a clip; segments meet them in time by the binned join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .frames import error_report, label_mapping
from .gates import verdict
from .range_join import overlap_join
from .segments import structure_profile


def role_overlaps(expectations: DataFrame, segments: DataFrame, by: Sequence[str], width: float = 5.0) -> DataFrame:
    """(by, role, speaker, seconds) over the single-role expectations."""
    single = expectations.filter("kind = 'single_role'").select(*by, "id", "role", "start", "end")
    met = overlap_join(single, segments.select(*by, "speaker", "start", "end"), by, width)
    return met.groupBy(*by, "role", F.col("r_speaker").alias("speaker")).agg(F.sum("overlap").alias("seconds"))


def role_mapping(overlaps: DataFrame, by: Sequence[str], whole: Sequence[str] | None = None) -> DataFrame:
    """(by, role, speaker): one to one, with the largest total, of equal ones the first by the speakers in order of roles (should there
    be fewer speakers, by the roles in order of speakers). ``whole``: a clip has all these roles mapped, or none."""
    return label_mapping(overlaps, by, pred="role", ref="speaker", value="seconds", whole=whole)


def sequence_found(labels: Column, wanted: Column) -> Column:
    """Whether the wanted labels occur in this order; a null is a wildcard that takes any one label."""
    def step(at: Column, x: Column) -> Column:
        want = F.try_element_at(wanted, at + 1)
        return F.when((at < F.size(wanted)) & (want.isNull() | (want == x)), at + 1).otherwise(at)

    return F.aggregate(labels, F.lit(0), step) == F.size(wanted)


def sequence_places(labels: Column, wanted: Column) -> Column:
    """The places (from 1) of the first embedding of the wanted labels, null if there is none. Taking each as early as possible is first."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("places"))

    def step(s: Column, x: Column) -> Column:
        want = F.try_element_at(wanted, s.i + 1)
        hit = (s.i < F.size(wanted)) & (want.isNull() | (want == x))
        return F.struct((s["at"] + 1).alias("at"), F.when(hit, s.i + 1).otherwise(s.i).alias("i"), F.when(hit, F.concat(s.places, F.array(s["at"] + 1))).otherwise(s.places).alias("places"))

    done = F.aggregate(labels, start, step)
    return F.when(done.i == F.size(wanted), done.places)


def assess_expectations(
    expectations: DataFrame, segments: DataFrame, mapping: DataFrame, by: Sequence[str], least_segment: float = 0.12, least_coverage: float = 0.55,
    most_speech: float = 0.25, width: float = 5.0, mapped_only: bool = False,
) -> DataFrame:
    """(by, id, kind, weight, passed). single_role: the mapped speaker covers enough; ordered_roles: the mapped speakers follow each
    other so; non_asr: little is spoken. A null among the roles takes any label, and so does a role without a speaker, unless
    ``mapped_only``: then the sequence fails."""
    met = overlap_join(expectations.select(*by, "id", "start", "end"), segments.select(*by, "seg_ord", "speaker", "start", "end"), by, width)
    length = F.col("end") - F.col("start")
    share = met.groupBy(*by, "id", "r_speaker").agg(F.sum("overlap").alias("s"))
    total = share.groupBy(*by, "id").agg(F.sum("s").alias("spoken"), F.map_from_entries(F.collect_list(F.struct("r_speaker", "s"))).alias("of"))
    heard = met.filter(F.col("overlap") >= least_segment)
    w = Window.partitionBy(*by, "id").orderBy("r_start", "r_seg_ord")
    heard = heard.withColumn("_new", ~F.lag("r_speaker").over(w).eqNullSafe(F.col("r_speaker"))).filter("_new")
    order = heard.groupBy(*by, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_start", "r_seg_ord", "r_speaker"))), lambda x: x.r_speaker).alias("labels"))
    roles = mapping.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("role", "speaker"))).alias("roles_of"))
    rows = expectations.join(total, [*by, "id"], "left").join(order, [*by, "id"], "left").join(roles, list(by), "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    names = F.coalesce("roles_of", none)
    seconds = F.coalesce(F.try_element_at("of", F.try_element_at(names, F.col("role"))), F.lit(0.0))
    single = seconds >= least_coverage * length
    wanted = F.transform("roles", lambda r: F.try_element_at(names, r))
    ordered = F.coalesce(sequence_found(F.coalesce("labels", F.array().cast("array<string>")), wanted), F.lit(False))
    if mapped_only:
        ordered &= ~F.exists("roles", lambda r: r.isNotNull() & F.try_element_at(names, r).isNull())
    quiet = F.coalesce("spoken", F.lit(0.0)) <= most_speech * length
    passed = F.when(F.col("kind") == "single_role", single).when(F.col("kind") == "ordered_roles", ordered).otherwise(quiet)
    return rows.select(*by, "id", "kind", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce(passed, F.lit(False)).alias("passed"))


def expectation_scores(assessed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, kind, expected, passed, score): weighted, for each kind and, with kind null, all."""
    return assessed.rollup(*by, "kind").agg(
        F.count("*").alias("expected"), F.count_if("passed").alias("passed"), (F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("score"),
        *[F.grouping(k).alias(f"_g{i}") for i, k in enumerate(by)],
    ).filter(" AND ".join([f"_g{i} = 0" for i in range(len(by))] or ["true"])).drop(*[f"_g{i}" for i in range(len(by))])


def full_report(
    prediction: DataFrame, by: Sequence[str], reference: DataFrame | None = None, expectations: DataFrame | None = None, total: DataFrame | None = None,
    step: float = 0.05, collar: float = 0.25, short: float = 0.5, width: float = 5.0, whole: Sequence[str] | None = None, **assessment: float,
) -> DataFrame:
    """One row a clip: all that is known of a prediction, with a null struct for what there is nothing to compare with.

    prediction, reference: structure profiles, over the clip's seconds (total: by, seconds; else to the last end of either).
    reference_metrics: diarization error. targeted: score and error of the expectations (share of their weight), counts, weights,
    by_kind (kind -> score), roles (role -> label), identity and the ids of the failures. whole: the roles of a clip, mapped all or
    not at all; roles then has each of them, with a null label where none is mapped, and no sequence passes by an unmapped role.
    """
    keys = list(by)
    if total is None:
        ends = prediction.select(*by, "end") if reference is None else prediction.select(*by, "end").union(reference.select(*by, "end"))
        total = ends.groupBy(*by).agg(F.max("end").alias("seconds"))
    total = written(total.select(*by, "seconds"), "clip-seconds")

    def profile(rows: DataFrame, name: str) -> DataFrame:
        found = structure_profile(rows.join(total, keys), by, short, F.col("seconds"))
        return found.select(*by, F.struct(*[c for c in found.columns if c not in keys]).alias(name))

    out = total.select(*by).join(profile(prediction, "prediction"), keys, "left")
    if reference is not None:
        rates = error_report(reference, prediction, by, step, collar, width, total)
        rates = rates.select(*by, F.struct(*[c for c in rates.columns if c not in keys]).alias("reference_metrics"))
        out = out.join(profile(reference, "reference"), keys, "left").join(rates, keys, "left")
    else:
        out = out.withColumn("reference", F.lit(None).cast(out.schema["prediction"].dataType)).withColumn("reference_metrics", F.lit(None).cast("struct<der: double>"))
    if expectations is None:
        return out.withColumn("targeted", F.lit(None).cast("struct<score: double>"))
    overlaps = role_overlaps(expectations, prediction, by, width)
    mapping = written(role_mapping(overlaps, by, whole), "roles")
    assessed = written(assess_expectations(expectations, prediction, mapping, by, width=width, mapped_only=whole is not None, **assessment), "assessed")
    kinds = expectation_scores(assessed, by).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "score"))))).alias("by_kind"))
    passed, weight = F.col("passed"), F.col("weight")
    sums = assessed.groupBy(*by).agg(
        F.count_if(passed).alias("passed_count"), F.count_if(~passed).alias("failed_count"), F.count("*").alias("expectation_count"),
        F.sum(F.when(passed, weight).otherwise(0.0)).alias("passed_weight"), F.sum("weight").alias("total_weight"), F.array_sort(F.collect_list(F.when(~passed, F.col("id")))).alias("failures"),
    )
    roles = mapping.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "speaker")))).alias("roles"))
    met = sums.join(kinds, keys, "left").join(roles, keys, "left").join(identity_scores(overlaps, by), keys, "left")
    if whole is not None:
        each = F.array(*map(F.lit, whole))
        met = met.withColumn("roles", F.map_from_arrays(each, F.transform(each, lambda r: F.try_element_at("roles", r))))
    score = F.when(F.col("total_weight") > 0, F.col("passed_weight") / F.col("total_weight")).otherwise(0.0)
    met = met.withColumn("score", score).withColumn("targeted_error", 1 - F.col("score"))
    return out.join(met.select(*by, F.struct(*[c for c in met.columns if c not in keys]).alias("targeted")), keys, "left")


def identity_scores(overlaps: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, share, distinctness, identity): each role's time with its main speaker, times how few roles share a speaker."""
    total = Window.partitionBy(*by, "role")
    main = overlaps.withColumn("_all", F.sum("seconds").over(total)).groupBy(*by, "role").agg(F.max(F.struct("seconds", "speaker")).alias("m"), F.max("_all").alias("all"))
    out = main.groupBy(*by).agg((F.sum("m.seconds") / F.sum("all")).alias("share"), (F.count_distinct("m.speaker") / F.count("*")).alias("distinctness"))
    return out.withColumn("identity", F.col("share") * F.col("distinctness"))


def compare(current: DataFrame, baseline: DataFrame, metrics: dict[str, bool], keys: Sequence[str]) -> DataFrame:
    """(keys, metric, current, baseline, verdict); metrics: name -> whether lower is better."""
    a, b = (d.select(*keys, *[F.col(m).cast("double").alias(f"{p}{m}") for m in metrics]) for d, p in ((current, "a_"), (baseline, "b_")))
    items = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("current"), F.col(f"b_{m}").alias("baseline"), verdict(F.col(f"a_{m}"), F.col(f"b_{m}"), low).alias("verdict"))
        for m, low in metrics.items()
    ])
    return a.join(b, list(keys)).select(*keys, F.explode(items).alias("x")).select(*keys, "x.*")


def should_adopt(candidates: DataFrame, by: Sequence[str], least_total: float, confident_total: float) -> DataFrame:
    """(by, adopt): candidates (by, speaker, start, end, confident, original) are taken if at least two speakers have enough time and
    one that is not the original has enough confident time."""
    length = F.col("end") - F.col("start")
    per = candidates.groupBy(*by, "speaker").agg(F.sum(length).alias("s"), F.sum(F.when(F.col("confident"), length).otherwise(0.0)).alias("c"), F.max("original").alias("original"))
    new = (F.col("speaker") != F.col("original")) & (F.col("c") >= confident_total)
    return per.groupBy(*by).agg(((F.count_if(F.col("s") >= least_total) >= 2) & F.bool_or(new)).alias("adopt"))


def candidate_reasons(duration: Column, merged: Column, low: float, high: float, long: float) -> Column:
    """Why a chunk may be challenged: long, merged, eligible; null outside the duration bounds."""
    held = F.array_compact(F.array(F.when(duration >= long, F.lit("long")), F.when(merged > 1, F.lit("merged")), F.when(duration < long, F.lit("eligible"))))
    return F.when(duration.between(low, high), held)
