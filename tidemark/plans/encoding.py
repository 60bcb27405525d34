"""Whole analyses: features and responses in, scores out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.align import LAG, lag_align
from tidemark.operators.metrics import correlations, over_parcels, scores, summary
from tidemark.operators.kernels import complete, kernel_ridge
from tidemark.operators.regression import ALPHAS, fold_fits, long_form, loo_fit, predict, ridge_alphas, ridge_fit
from tidemark.operators.report import least_values
from tidemark.operators.rows import with_rank
from tidemark.operators.splits import clip_split, folds, of_part
from tidemark.sources.storage import written


def lagged_pairs(rows: DataFrame, lag: int = LAG) -> DataFrame:
    """(clip, tr, parcel, x, y): each number of a step with the same one ``lag`` steps on."""
    later = rows.select("clip", "tr", F.col("embedding").alias("later"))
    both = lag_align(rows.select("clip", "tr", "embedding"), later, lag=lag)
    both = both.select("clip", "tr", F.posexplode(F.arrays_zip("embedding", "later")).alias("parcel", "_z"))
    return both.select("clip", "tr", F.col("parcel").cast("long").alias("parcel"), F.col("_z.embedding").cast("double").alias("x"), F.col("_z.later").cast("double").alias("y"))


def lag_correlations(rows: DataFrame, lag: int = LAG) -> DataFrame:
    """(parcel, r, n) over all clips."""
    return correlations(lagged_pairs(rows, lag), "parcel")


def ridge_test_scores(rows: DataFrame, alpha: float = 1000.0, lag: int = 0) -> DataFrame:
    """(parcel, r, r2, n) on the test clips, of one ridge fit to the training clips; rows are
    (clip, tr, x, y)."""
    aligned = lag_align(rows.select("clip", "tr", "x"), rows.select("clip", "tr", "y"), lag=lag)
    split = clip_split(rows.select("clip").distinct())
    fit = ridge_fit(of_part(aligned, split, True), alpha=alpha)
    return scores(long_form(predict(of_part(aligned, split, False), fit), "clip"), "parcel")


def cross_validated(rows: DataFrame, alpha: float, model: str = "ridge", k: int = 5, *order: str) -> DataFrame:
    """One row of mean, median and maximum r and the percentage above 0, of predictions for
    each fold from all others, pooled before they are scored. An undefined r counts as 0."""
    dealt = folds(rows, k, *(order or ("clip", "tr")))
    predicted = predict(dealt, fold_fits(dealt, k, alpha, model), "fold")
    return summary(correlations(long_form(predicted, "fold"), "parcel", x="p", zero_fill=True))


def clip_scores(pairs: DataFrame) -> DataFrame:
    """Scores within each clip, averaged over parcels."""
    return over_parcels(scores(pairs, "clip", "parcel", p="x"), "clip")


def sweep(rows: DataFrame, lags: list[int]) -> DataFrame:
    """(lag, mean_r, n): the mean correlation for each lag of a grid. The grid is a small
    table that each row is joined with once; lags aren't run one after another."""
    grid = rows.sparkSession.createDataFrame([(k,) for k in lags], "lag int")
    x = rows.select("clip", "tr", "embedding").crossJoin(F.broadcast(grid))  # a stated grid
    later = rows.select("clip", F.col("tr").alias("_tr"), F.col("embedding").alias("later"))
    both = x.withColumn("_tr", F.col("tr") + F.col("lag")).join(later, ["clip", "_tr"])
    both = both.select("lag", F.posexplode(F.arrays_zip("embedding", "later")).alias("parcel", "_z"))
    r = correlations(both.select("lag", "parcel", F.col("_z.embedding").cast("double").alias("x"), F.col("_z.later").cast("double").alias("y")), "lag", "parcel")
    return r.groupBy("lag").agg(F.avg("r").alias("mean_r"), F.max("n").alias("n"))


OK = "ok"  # the status of a variant that ran


def analysis_sweep(
    features: DataFrame, responses: DataFrame, lags: tuple[int, ...], alphas: tuple[float, ...], fraction: float = 0.8, least_train: int = 4, least_test: int = 1
) -> DataFrame:
    """One row for each feature key, lag and alpha: status, n_train, n_test, n_clips, mean and
    median r and r2 over parcels of the test clips, of features (feature_key, clip, tr, x) and
    responses (clip, tr, y). An undefined r counts as 0.

    All lags are aligned in one join, and their sums made in one pass; each feature key and
    lag has one decomposition, for all alphas. A variant that can't be run has a status
    that tells why, and no scores; others go on. Rows with arrays that are null, or hold
    null or NaN, take no part; clips with fewer than two aligned steps don't count. The
    first clips train, so many as the fraction rounded down, within the least numbers.
    """
    spark, by = features.sparkSession, ("feature_key", "lag")
    grid = spark.createDataFrame([(k,) for k in lags], "lag int")
    wanted = features.select("feature_key").distinct().crossJoin(F.broadcast(grid))  # a stated grid
    x = features.where(complete("x")).select("feature_key", "clip", "tr", "x").crossJoin(F.broadcast(grid)).withColumn("_tr", F.col("tr") + F.col("lag"))
    later = responses.where(complete("y")).select("clip", F.col("tr").alias("_tr"), "y")
    aligned = written(x.join(later, ["clip", "_tr"]).drop("_tr"), "aligned")
    clips = aligned.groupBy(*by, "clip").agg(F.count("*").alias("n"), *[f(F.size(c)).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)])
    clips = written(with_rank(clips.where("n > 1"), by, "clip"), "clips")  # one row a clip, whatever its length
    facts = clips.groupBy(*by).agg(F.count("*").alias("n_clips"), *[f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)])
    uneven = (F.col("min_x") < F.col("max_x")) | (F.col("min_y") < F.col("max_y"))
    status = F.when(F.col("n_clips").isNull(), "no aligned steps").when(F.col("n_clips") < least_train + least_test, F.concat(F.lit("too few clips to split: "), "n_clips"))
    status = status.when(uneven, "rows with different numbers of features or responses").otherwise(OK)
    variants = written(wanted.join(facts, list(by), "left").select(*by, "n_clips", status.alias("status")), "variants")
    n_train = F.greatest(F.lit(least_train), F.least(F.floor(F.col("n_clips") * F.lit(fraction)), F.col("n_clips") - least_test))
    split = clips.join(variants.where(F.col("status") == OK), list(by)).withColumn("train", F.col("rank") < n_train)
    split = written(split.select(*by, "clip", "n", "train"), "split")
    counts = split.groupBy(*by).agg(*[F.sum(F.when(F.col("train") == t, F.col("n")).otherwise(0)).alias(name) for t, name in ((True, "n_train"), (False, "n_test"))])
    fits = written(ridge_alphas(of_part(aligned, split, True, *by, "clip"), *by, alphas=alphas), "fits")
    p = predict(of_part(aligned, split, False, *by, "clip"), fits.where("error is null"), *by)
    each = p.select(*by, "y", F.posexplode("p").alias("_k", "p"))  # of each alpha, one after another, as many as responses
    size = F.size("y")
    pairs = each.select(*by, F.floor(F.col("_k") / size).cast("int").alias("_alpha"), (F.col("_k") % size).alias("parcel"), F.get("y", F.col("_k") % size).cast("double").alias("y"), "p")
    found = over_parcels(scores(pairs, *by, "_alpha", "parcel", zero_fill=True), *by, "_alpha")
    values = spark.createDataFrame(list(enumerate(map(float, alphas))), "_alpha int, alpha double")
    d = variants.crossJoin(F.broadcast(values)).join(counts, list(by), "left").join(fits.select(*by, "error"), list(by), "left")  # a stated grid
    d = d.join(found, [*by, "_alpha"], "left").withColumn("status", F.coalesce("error", "status"))
    return d.select(*by, "alpha", "status", F.coalesce("n_clips", F.lit(0)).alias("n_clips"), "n_train", "n_test", "mean_r", "median_r", "mean_r2", "median_r2")


def fitted(train: DataFrame, test: DataFrame, *by: str, order: tuple[str, ...], alphas: tuple[float, ...] = ALPHAS) -> tuple[DataFrame, DataFrame]:
    """(fits: by, alpha, num_targets, feature_dim; predictions: test's columns and p) of one ridge
    regression on standardised features for each group, with the alpha of least
    leave-one-out error. Groups that all have at most as many features as rows are fitted from
    sums of products of features; if one has more, all are from products of rows."""
    sizes = train.where(complete("x", "y")).groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"))
    if sizes.where("d > n").isEmpty():
        fits = written(loo_fit(train, *by, alphas=alphas), "alphas")
        sizes = fits.select(*by, "alpha", F.size("b").alias("num_targets"), (F.size("w") / F.size("b")).cast("int").alias("feature_dim"))
        return sizes, predict(test, fits, *by)
    fits, p = kernel_ridge(train, test.select(*by, *order, "x"), *by, order=order, alphas=alphas, scale=True)
    return fits.select(*by, "alpha", "num_targets", "feature_dim"), test.join(p, [*by, *order])


def subject_analysis(
    features: DataFrame, responses: DataFrame, alphas: tuple[float, ...] = ALPHAS, lag: int = LAG, fraction: float = 0.8, least_train: int = 4, least_test: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(predictions, reports) of the main analysis: features (clip, tr, x) and responses
    (subject, clip, tr, y) are aligned; per subject the first clips train, with the alpha
    of least leave-one-out error on standardised features, and the others are predicted.

    predictions: subject, clip, tr, y, p. reports: per subject alpha, lag_trs, counts of
    samples, features, targets and clips, the clips of both parts and those without a
    partner, mean and median scores over parcels, and arrays of each clip's alignment and
    scores. A subject has as many clips as were shown: such arrays are bounded by the
    study, not by the length of recordings.
    """
    aligned = written(lag_align(features, responses, lag=lag), "aligned")
    clips = aligned.groupBy("subject", "clip").agg(F.count("*").alias("num_aligned_trs"))
    clips = clips.join(least_values(aligned, "tr", "tr_preview", "subject", "clip"), ["subject", "clip"])
    split = written(clip_split(clips, fraction=fraction, least_train=least_train, least_test=least_test, group=("subject",)), "split")
    keys = ("subject", "clip")
    train, test = of_part(aligned, split, True, *keys), of_part(aligned, split, False, *keys)
    sizes, predictions = fitted(train, test, "subject", order=("clip", "tr"), alphas=alphas)
    predictions = written(predictions.select(*keys, "tr", "y", "p"), "predictions")
    pairs = written(long_form(predictions, *keys), "pairs")
    r = scores(pairs, "subject", "parcel", zero_fill=True)
    whole = over_parcels(r, "subject").select("subject", *[F.col(c).alias(c.replace("_r2", "_test_r2") if c.endswith("r2") else c.replace("_r", "_test_pearson")) for c in ("mean_r", "median_r", "mean_r2", "median_r2")])
    each = over_parcels(scores(pairs, *keys, "parcel", zero_fill=True), *keys).withColumnRenamed("n_parcels", "_n")
    tested = each.join(split.select(*keys, "num_aligned_trs"), list(keys))
    tested = tested.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("clip", F.col("num_aligned_trs").alias("num_test_trs"), F.col("mean_r").alias("mean_test_pearson"), F.col("mean_r2").alias("mean_test_r2")))).alias("per_clip_test_metrics"))
    raw_x = features.groupBy("clip").agg(F.count("*").alias("num_feature_trs_raw"))
    raw_y = responses.groupBy(*keys).agg(F.count("*").alias("num_response_trs_raw"))
    alignment = split.join(raw_x, "clip").join(raw_y, list(keys))
    ids = lambda on: F.array_sort(F.collect_list(F.when(F.col("train") == on, F.col("clip"))))
    counts = alignment.groupBy("subject").agg(
        F.sum(F.when(F.col("train"), F.col("num_aligned_trs")).otherwise(0)).alias("n_train_samples"),
        F.sum(F.when(~F.col("train"), F.col("num_aligned_trs")).otherwise(0)).alias("n_test_samples"),
        F.count("*").alias("num_matched_clips"),
        ids(True).alias("train_clip_ids"),
        ids(False).alias("test_clip_ids"),
        F.array_sort(F.collect_list(F.struct("clip", "num_feature_trs_raw", "num_response_trs_raw", "num_aligned_trs", "tr_preview"))).alias("per_clip_alignment"),
    )
    matched = split.select(*keys)
    # Each clip is asked of each subject: a subject's clips, of which there are as many as were
    # shown, are taken from all of them, which are one row.
    every = features.agg(F.collect_set("clip").alias("_every"))
    own = matched.groupBy("subject").agg(F.collect_set("clip").alias("_own")).crossJoin(F.broadcast(every))
    missing = own.select("subject", F.array_sort(F.array_except("_every", "_own")).alias("missing_clips"))
    unmatched = responses.select(*keys).distinct().join(matched, list(keys), "left_anti").groupBy("subject").agg(F.array_sort(F.collect_list("clip")).alias("unmatched_clips"))
    reports = sizes.withColumn("lag_trs", F.lit(lag)).withColumn("train_fraction", F.lit(fraction))
    for part in (counts, whole, tested):
        reports = reports.join(part, "subject")
    for part in (missing, unmatched):
        name = part.columns[1]
        reports = reports.join(part, "subject", "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return predictions, reports
