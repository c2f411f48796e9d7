"""Evaluation with explicit denominators: confusion rates, AUROC, discriminant model, benchmark metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import logistic, ratio, wilson
from .relational import dimension


def confusion(df: DataFrame, actual: Column, predicted: Column, by=()) -> DataFrame:
    """TP, FN, TN, FP and rates; a rate over nothing is NULL. Abstentions (NULL predictions) are counted apart."""
    a, p = F.coalesce(actual, F.lit(False)), predicted
    out = df.groupBy(*by).agg(
        F.count_if(a & p).alias("tp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"), F.count_if(~a & p).alias("fp"), F.count_if(p.isNull()).alias("abstained")
    )
    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    return out.withColumns({"accuracy": ratio(tp + tn, tp + fn + tn + fp), "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def rank_sum(df: DataFrame, positive: Column, score: str, by=()) -> DataFrame:
    """positives, negatives, U of the positives, and ties (sum of t^3 - t over sets of t equal scores).

    Scores are first counted per distinct value, so ties cost nothing and ranks are a running sum over distinct scores,
    not over rows; equal to counting concordant pairs and half the ties.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"))
    below = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    t = (F.col("_p") + F.col("_n")).cast("double")
    return counts.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).groupBy(*by).agg(
        F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2.0)).alias("u"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), F.sum(t * t * t - t).alias("ties"))


def auroc(df: DataFrame, positive: Column, score: str, by=()) -> DataFrame:
    """Area under the curve by rank sums."""
    return rank_sum(df, positive, score, by).withColumn("auroc", ratio(F.col("u"), F.col("positives") * F.col("negatives"))).drop("u", "ties")


def fit_discriminant(long: DataFrame, label: str, feature: str, value: str, floor: float = 1e-12) -> DataFrame:
    """Diagonal linear discriminant on (label in 0/1, feature, value) rows: one grouped pass for counts, sums and squares.

    Per feature: centre, scale, the two centroids and the coefficient; variance is pooled within classes over n - 2.
    """
    v, y = F.col(value), F.col(label)
    stats = long.groupBy(feature).agg(
        F.avg(v).alias("centre"), *[F.avg(F.when(y == c, v)).alias(f"mean{c}") for c in (0, 1)], *[F.count_if(y == c).alias(f"n{c}") for c in (0, 1)], *[F.var_pop(F.when(y == c, v)).alias(f"var{c}") for c in (0, 1)])
    pooled = (F.col("var0") * F.col("n0") + F.col("var1") * F.col("n1")) / (F.col("n0") + F.col("n1") - 2)
    out = stats.withColumn("scale", F.sqrt(F.greatest(pooled, F.lit(floor))))
    out = out.withColumns({f"centroid{c}": F.round((F.col(f"mean{c}") - F.col("centre")) / F.col("scale"), 12) for c in (0, 1)})
    return out.withColumn("coefficient", F.col("centroid1") - F.col("centroid0")).select(feature, "centre", "scale", "centroid0", "centroid1", "coefficient", "n0", "n1")


def score_discriminant(long: DataFrame, model: DataFrame, key: str, feature: str, value: str, min_features: int) -> DataFrame:
    """Log odds over the features a row has; too few of them, or a sum that is not finite, gives an abstention (NULL)."""
    m = dimension(model)  # a row for each feature of the allow-list
    z = (F.col(value) - F.col("centre")) / F.col("scale")
    term = z * F.col("coefficient") - (F.col("centroid1") * F.col("centroid1") - F.col("centroid0") * F.col("centroid0")) / 2
    found = long.filter(F.col(value).isNotNull()).join(m, feature).groupBy(key).agg(F.count("*").alias("features"), F.sum(term).alias("_t"), F.first(F.log(F.col("n1") / F.col("n0"))).alias("_prior"))
    odds = F.col("_t") + F.col("_prior")
    fine = (F.col("features") >= min_features) & ~F.isnan(odds) & (F.abs(odds) < float("inf"))
    out = found.withColumn("log_odds", F.when(fine, odds)).withColumn("probability", logistic(F.col("log_odds")))
    return out.withColumn("predicted", F.when(F.col("probability").isNotNull(), F.col("probability") >= 0.5)).select(key, "features", "log_odds", "probability", "predicted")


def split_leaks(train: DataFrame, test: DataFrame, keys: list[str], vector: list[str]) -> DataFrame:
    """Ids or whole feature vectors that are in both splits; must be empty."""
    ids = train.select(*keys).intersect(test.select(*keys)).select(F.concat_ws("|", *keys).alias("what"), F.lit("id").alias("kind"))
    vectors = train.select(*vector).intersect(test.select(*vector)).select(F.concat_ws("|", *[F.col(v).cast("string") for v in vector]).alias("what"), F.lit("feature_vector").alias("kind"))
    return ids.unionByName(vectors)


def shared_values(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(column, shared): how many distinct values of a column both splits have; NULL is no value. Values are told apart by
    their SHA-256, so that long texts cost as much as ids; both splits are taken apart in one scan."""

    def cells(df: DataFrame, side: str) -> DataFrame:
        held = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.unhex(F.sha2(F.col(c).cast("string"), 256)).alias("value")) for c in columns])).alias("x")
        return df.select(held).select("x.*").filter("value is not null").withColumn("side", F.lit(side))

    met = cells(train, "train").unionByName(cells(test, "test")).groupBy("column", "value").agg((F.min("side") != F.max("side")).alias("both"))
    counts = met.groupBy("column").agg(F.count_if("both").alias("shared"))
    named = train.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return F.broadcast(named).join(counts, "column", "left").select("column", F.coalesce("shared", F.lit(0).cast("bigint")).alias("shared"))


def label_copies(long: DataFrame, label: str, feature: str, value: str) -> DataFrame:
    """Features that are constant within each class and differ between them: copies of the label."""
    by = long.groupBy(feature, label).agg(F.count_distinct(value).alias("k"), F.min(value).alias("v"))
    return by.groupBy(feature).agg(F.max("k").alias("k"), F.count_distinct("v").alias("values"), F.count("*").alias("classes")).filter("k = 1 and values = classes and classes > 1").select(feature)


def invalid_predictions(scored: DataFrame) -> DataFrame:
    """Scored rows that break their contract: probability outside [0, 1], label not from it, or half-empty abstentions."""
    p, y, o = F.col("probability"), F.col("predicted"), F.col("log_odds")
    bad = (p.isNull() != y.isNull()) | (p.isNull() != o.isNull()) | ~p.between(0, 1) | (y != (p >= 0.5)) | (F.abs(p - logistic(o)) > 1e-9)
    return scored.filter(F.coalesce(bad, F.lit(False)))


#: Outcomes of a benchmark case; the first that applies counts.
OUTCOMES = ("missing_prediction", "unexpected_prediction", "scope_status_mismatch", "common_variable_mismatch", "review_status_mismatch", "quality_score_not_reported", "quality_score_outside_tolerance", "unsafe_auto_accept", "correct")


MISSING_MAPPING = "not_mapped"


def _mapped(side: str, *statuses: str) -> Column:
    """Rows of a side (p or g) that map to something under one of the statuses."""
    return F.coalesce((F.col(f"{side}_common_variable") != MISSING_MAPPING) & F.col(f"{side}_review_status").isin(*statuses), F.lit(False))


def mapping_cases(joined: DataFrame) -> DataFrame:
    """Cases of a full outer join of mappings (p_/g_ common_variable and review_status) with all reasons and the first as outcome."""
    both = F.col("in_predicted") & F.col("in_gold")
    differ = lambda c: both & ~F.col(f"p_{c}").eqNullSafe(F.col(f"g_{c}"))
    confirmed = both & F.coalesce(F.col("g_review_status") == "accepted", F.lit(False)) & ~differ("common_variable")
    found = {
        "missing_prediction": ~F.col("in_predicted"), "unexpected_prediction": ~F.col("in_gold"), "common_variable_mismatch": differ("common_variable"), "review_status_mismatch": differ("review_status"),
        "unsafe_auto_accept": _mapped("p", "accepted") & ~confirmed,
    }
    reasons = F.array_compact(F.array(*[F.when(found[o], F.lit(o)) for o in OUTCOMES if o in found]))
    return joined.withColumn("reason_codes", F.array_join(reasons, ";")).withColumn("outcome", F.when(F.size(reasons) > 0, reasons[0]).otherwise("correct"))


# A scope that nobody declared, and the one that has no score.
NOT_DECLARED, OUT_OF_SCOPE = "not_declared", "out_of_scope_non_human"


def quality_cases(joined: DataFrame, tolerance: str = "0.15") -> DataFrame:
    """Each joined study with its reasons, outcome, absolute_difference and within_tolerance. Where the expert put a study out of
    scope only the scopes are compared; a scope that a side doesn't declare can't differ."""
    both, scope = F.col("in_predicted") & F.col("in_gold"), lambda side: F.coalesce(F.col(f"{side}_scope_status"), F.lit(NOT_DECLARED))
    compared = both & (scope("g") != OUT_OF_SCOPE)
    scores = [F.col(f"{side}_overall_score").cast("decimal(10,6)") for side in "pg"]
    difference = F.when(compared, F.abs(scores[0] - scores[1]))
    within = difference <= F.lit(tolerance).cast("decimal(10,6)")
    found = {
        "missing_prediction": ~F.col("in_predicted"), "unexpected_prediction": ~F.col("in_gold"), "scope_status_mismatch": both & (scope("g") != NOT_DECLARED) & (scope("p") != NOT_DECLARED) & (scope("g") != scope("p")),
        "quality_score_not_reported": compared & scores[0].isNull(), "quality_score_outside_tolerance": F.coalesce(~within, F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(found[o], F.lit(o)) for o in OUTCOMES if o in found]))
    return joined.withColumns({"reason_codes": F.array_join(reasons, ";"), "outcome": F.when(F.size(reasons) > 0, reasons[0]).otherwise("correct"), "absolute_difference": difference, "within_tolerance": within})


def disagreements(mappings: DataFrame, quality: DataFrame, study: Column, variable: Column) -> DataFrame:
    """The cases that aren't correct as one table of 16 columns; what a kind of case doesn't have is NULL. ``study`` and
    ``variable`` name a mapping case; a quality case's study is its key ``study``."""
    none = lambda kind: F.lit(None).cast(kind)
    scores, pair = ("gold_overall_score", "predicted_overall_score"), lambda c: (F.col(f"g_{c}").alias(f"gold_{c}"), F.col(f"p_{c}").alias(f"predicted_{c}"))
    maps = mappings.filter("outcome <> 'correct'").select(
        F.lit("mapping").alias("case_type"), study.alias("source_study"), variable.alias("source_variable"), F.coalesce("g_common_variable", "p_common_variable").alias("common_variable"), "outcome", "reason_codes", *pair("common_variable"), *pair("review_status"),
        *[none("decimal(10,6)").alias(c) for c in scores], none("string").alias("gold_scope_status"), none("string").alias("predicted_scope_status"), none("decimal(10,6)").alias("absolute_difference"), none("boolean").alias("within_tolerance"))
    studies = quality.filter("outcome <> 'correct'").select(
        F.lit("quality").alias("case_type"), study.alias("source_study"), none("string").alias("source_variable"), none("string").alias("common_variable"), "outcome", "reason_codes", *[none("string").alias(c) for c in ("gold_common_variable", "predicted_common_variable", "gold_review_status", "predicted_review_status")],
        *[F.col(f"{c[0]}_overall_score").cast("decimal(10,6)").alias(c) for c in scores], *pair("scope_status"), F.col("absolute_difference").cast("decimal(10,6)").alias("absolute_difference"), "within_tolerance")
    return maps.unionByName(studies)


def _rates(counts: DataFrame, names: list[str], *more: str) -> DataFrame:
    """(metric, hits, total, value, low, high, undefined_reason) of count columns h_ and t_; the value has three decimals."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"h_{m}").alias("hits"), F.col(f"t_{m}").alias("total")) for m in names])
    long = counts.select(*more, F.explode(rows).alias("x")).select(*more, "x.*")
    low, high = wilson(F.col("hits"), F.col("total"))
    return long.withColumns({"value": F.round(ratio(F.col("hits"), F.col("total")), 3), "low": F.round(low, 6), "high": F.round(high, 6), "undefined_reason": F.when(F.col("total") == 0, "zero_denominator")})


def mapping_metrics(joined: DataFrame) -> DataFrame:
    """The eight mapping metrics from one pass over the joined cases. A hit is the same variable under the same status."""
    same = F.coalesce((F.col("p_common_variable") == F.col("g_common_variable")) & (F.col("p_review_status") == F.col("g_review_status")), F.lit(False))
    candidate, wanted = _mapped("p", "accepted", "requires_human_review"), _mapped("g", "accepted", "requires_human_review")
    auto, auto_gold, review_gold = _mapped("p", "accepted"), _mapped("g", "accepted"), _mapped("g", "requires_human_review")
    pairs = {
        "candidate_precision": (candidate & wanted & same, candidate), "candidate_recall": (candidate & wanted & same, wanted), "auto_accept_precision": (auto & auto_gold & same, auto), "auto_accept_recall": (auto & auto_gold & same, auto_gold),
        "unsafe_auto_accept_rate": (auto & ~(auto_gold & same), auto), "review_capture_rate": (review_gold & same, review_gold), "review_status_accuracy": (F.col("in_gold") & same, F.col("in_gold")),
    }
    counts = joined.agg(*[F.count_if(h).alias(f"h_{m}") for m, (h, _) in pairs.items()], *[F.count_if(t).alias(f"t_{m}") for m, (_, t) in pairs.items()])
    # derived of both, so without an interval: 2 tp / (2 tp + fp + fn), where tp + fp and tp + fn are the two totals
    whole = F.col("t_candidate_precision") + F.col("t_candidate_recall")
    f1 = counts.select(F.lit("candidate_f1").alias("metric"), (2 * F.col("h_candidate_precision")).alias("hits"), whole.alias("total"))
    f1 = f1.withColumns({"value": F.round(ratio(F.col("hits"), F.col("total")), 3), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "undefined_reason": F.when(F.col("total") == 0, "zero_denominator")})
    return _rates(counts, list(pairs)).unionByName(f1)


def quality_metrics(joined: DataFrame, tolerance: str = "0.15", provided: bool = True) -> DataFrame:
    """Score agreement within an inclusive decimal tolerance, and accuracy of the scope; a missing prediction is a failure."""
    gold, pred, scope = F.col("g_overall_score").cast("decimal(10,6)"), F.col("p_overall_score").cast("decimal(10,6)"), F.col("g_scope_status")
    scored = F.col("in_gold") & F.coalesce(scope != "out_of_scope_non_human", F.lit(True))
    declared = F.col("in_gold") & F.coalesce(scope != "not_declared", F.lit(False))
    pairs = {
        f"quality_score_agreement_within_{tolerance}": (scored & F.coalesce(F.abs(pred - gold) <= F.lit(tolerance).cast("decimal(10,6)"), F.lit(False)), scored),
        "scope_status_accuracy": (declared & F.coalesce(F.col("p_scope_status") == scope, F.lit(False)), declared),
    }
    names = [m.replace(".", "_") for m in pairs]
    counts = joined.agg(*[F.count_if(h).alias(f"h_{n}") for n, (h, _) in zip(names, pairs.values())], *[F.count_if(t).alias(f"t_{n}") for n, (_, t) in zip(names, pairs.values())], F.count_if("in_gold").alias("gold"))
    none = F.when(F.lit(not provided), "quality_inputs_not_provided").when((F.col("total") == 0) & (F.col("metric") == names[1]) & (F.col("gold") > 0), "scope_status_not_declared_in_gold").otherwise(F.col("undefined_reason"))
    rates = _rates(counts, names, "gold").withColumn("undefined_reason", none).drop("gold")
    return rates.withColumn("metric", F.when(F.col("metric") == names[0], list(pairs)[0]).otherwise(F.col("metric")))


def benchmark_metrics(mappings: DataFrame, quality: DataFrame) -> DataFrame:
    """All ten metrics of a benchmark run."""
    return mapping_metrics(mappings).unionByName(quality_metrics(quality))


def gate_rollup(tests: DataFrame, gate: str, outcome: str) -> DataFrame:
    """A gate passes if all its tests passed; a skip fails it."""
    return tests.groupBy(gate).agg(F.count("*").alias("tests"), F.count_if(F.col(outcome) == "passed").alias("passed"), F.bool_and(F.col(outcome) == "passed").alias("gate_passed"))


def contract_score(text: Column, all_of: list[str], any_of: list[str]) -> Column:
    """Mean of two checks: every required term occurs, and one of the alternatives does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    terms = lambda words: F.array(*[F.lit(w.lower()) for w in words])
    every = F.forall(terms(all_of), lambda w: F.contains(low, w)) if all_of else F.lit(True)
    some = F.exists(terms(any_of), lambda w: F.contains(low, w)) if any_of else F.lit(True)
    return (every.cast("double") + some.cast("double")) / 2
