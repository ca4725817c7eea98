"""Model-table preparation and prediction post-processing.

Per-group statistics are ``groupBy`` aggregates joined back on the group key (partial
aggregation keeps a hot session cheap), never a collect to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ranks import dense_codes, exact_quantiles, select_ranks

MISSING_CAT = "MISSING_CAT"  # fixed value: token for a missing category


def split_columns(df: DataFrame, target: str) -> dict[str, list[str]]:
    """M1: categorical (string/boolean) vs continuous columns from the schema, target excluded."""
    cat, cont = [], []
    for f in df.schema.fields:
        if f.name == target:
            continue
        (cat if isinstance(f.dataType, (T.StringType, T.BooleanType)) else cont).append(f.name)
    assert not set(cat) & set(cont)
    return {"categorical": cat, "continuous": cont}


def fit_labels(df: DataFrame, col: str) -> DataFrame:
    """M2: (value, code) with classes sorted and the missing token always present (any number of classes)."""
    vals = df.select(F.coalesce(F.col(col).cast("string"), F.lit(MISSING_CAT)).alias("value"))
    vals = vals.unionByName(df.sparkSession.range(1).select(F.lit(MISSING_CAT).alias("value")))
    return dense_codes(vals).withColumn("code", F.col("code").cast("int"))


def apply_labels(df: DataFrame, col: str, labels: DataFrame, out: str | None = None) -> DataFrame:
    """M2: replace a category by its code; values never seen when fitting get code 0.

    The label table has one row per distinct class; the join is left to AQE, which
    broadcasts it at run time when it is small.
    """
    out = out or f"{col}_code"
    key = F.coalesce(F.col(col).cast("string"), F.lit(MISSING_CAT))
    lab = labels.select(F.col("value").alias("_v"), F.col("code").alias(out))
    return df.withColumn("_v", key).join(lab, on="_v", how="left").withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("_v")


def fit_scaler(df: DataFrame, col: str) -> DataFrame:
    """M3: one row (median, mean, population std) of the column after median fill; the median is exact."""
    med = exact_quantiles(df.select(F.col(col).cast("double").alias("x")), [], [0.5]).select(F.col("value").alias("median"))
    med = df.sparkSession.range(1).join(med, F.lit(True), "left").select("median")  # null where the column has no value
    filled = df.crossJoin(F.broadcast(med)).select(F.coalesce(F.col(col).cast("double"), F.col("median")).alias("_x"), "median")
    return filled.agg(F.first("median").alias("median"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"))


def apply_scaler(df: DataFrame, col: str, scaler: DataFrame, out: str | None = None) -> DataFrame:
    """M3: (x filled with the median - mean) / std; the one-row scaler is broadcast."""
    out = out or f"{col}_scaled"
    j = df.crossJoin(F.broadcast(scaler))
    x = F.coalesce(F.col(col).cast("double"), F.col("median"))
    return j.withColumn(out, F.try_divide(x - F.col("mean"), F.col("std"))).drop("median", "mean", "std")


def split_train(df: DataFrame, frac: float, k, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """M4: train / validation label with exactly round(frac x rows) validation rows in every stratum, those with the
    smallest md5 of key and seed.

    The threshold of a stratum is the hash at that rank, found by ``select_ranks``; rows then compare with it, so no
    stratum is ever sorted or held in one task.  The key names a row: rows that repeat a key get one label, with the share off by
    as many.  With a stratum of a single row the split is done without strata, as a stratified one has no row to spare.
    """
    k = [k] if isinstance(k, str) else list(k)
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in k], F.lit(str(seed))))
    rows = df.select("*", digest.alias("_md5"), (F.col(stratum) if stratum else F.lit(0)).alias("_stratum"))
    rows = rows.withColumn("x", F.conv(F.substring("_md5", 1, 12), 16, 10).cast("double"))  # 48 bits: exact as a double
    sizes = cut_lineage(rows.groupBy("_stratum").agg(F.count("*").alias("_n")))
    if not sizes.where("_n < 2").isEmpty():
        rows = rows.withColumn("_stratum", F.lit(0))
        sizes = sizes.agg(F.sum("_n").alias("_n")).where("_n > 0").select(F.lit(0).alias("_stratum"), "_n")
    want = sizes.select("_stratum", F.floor(F.col("_n") * frac + 0.5).alias("_want"))
    found = select_ranks(rows, ["_stratum"], want.select("_stratum", (F.col("_want") - 1).alias("r")))
    found = cut_lineage(found.select(F.col("_stratum").alias("_s"), F.col("value").alias("_at"), (F.col("r") + 1 - F.col("below")).alias("_need")))
    # of the hashes that agree in 48 bits the whole ones decide: a handful
    ties = (rows.join(found, F.col("_stratum").eqNullSafe(F.col("_s"))).where("x = _at").groupBy("_s", "_at", "_need")
            .agg(F.sort_array(F.collect_set("_md5")).alias("_whole")).select("_s", "_at", F.get("_whole", F.least(F.col("_need"), F.size("_whole")).cast("int") - 1).alias("_last")))
    out = rows.join(ties, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    valid = F.coalesce((F.col("x") < F.col("_at")) | ((F.col("x") == F.col("_at")) & (F.col("_md5") <= F.col("_last"))), F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.when(valid, F.lit("valid")).otherwise(F.lit("train")).alias("split"))


def normalise_by_session(df: DataFrame, pred: str, session: str, out: str | None = None) -> DataFrame:
    """Within each session shift predictions so the mean is 0.5, clip to [0, 1]; if clipping
    moved the mean by more than 1e-6, scale about 0.5 by 0.5 / mean and clip again."""
    out = out or f"{pred}_norm"
    m1 = df.groupBy(session).agg(F.avg(pred).alias("_m1"))
    a = df.join(m1, on=session, how="left")
    a = a.withColumn("_adj", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(pred) - F.col("_m1") + 0.5)))
    m2 = a.groupBy(session).agg(F.avg("_adj").alias("_m2"))
    b = a.join(m2, on=session, how="left")
    scaled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + (F.col("_adj") - 0.5) * F.try_divide(F.lit(0.5), F.col("_m2"))))
    b = b.withColumn(out, F.when(F.abs(F.col("_m2") - 0.5) > 1e-6, scaled).otherwise(F.col("_adj")))
    return b.drop("_m1", "_adj", "_m2")


def prediction_table(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """M5: error and absolute error columns next to prediction and actual."""
    return df.withColumns({"error": F.col(pred) - F.col(actual), "abs_error": F.abs(F.col(pred) - F.col(actual))})


def constraint_check(df: DataFrame, col: str, session: str, target: float = 0.5) -> DataFrame:
    """M6: largest distance of a session mean from the target."""
    return df.groupBy(session).agg(F.avg(col).alias("_m")).agg(F.max(F.abs(F.col("_m") - target)).alias("max_session_dev"))


def prediction_labels(df: DataFrame, pred_code: str, actual: str, labels: DataFrame) -> DataFrame:
    """M5 for a category: label of the predicted code, code of the actual label and whether they match.

    ``labels`` is the (value, code) table of ``fit_labels``; a code that it lacks has a null label and matches nothing.
    The joins are equi-joins left to AQE, which broadcasts the label table where it is small at run time.
    """
    coded = apply_labels(df, actual, labels, "actual_code")
    names = labels.select(F.col("code").alias("_code"), F.col("value").alias("pred_label"))
    out = coded.join(names, coded[pred_code] == F.col("_code"), "left").drop("_code")
    actual_label = F.coalesce(F.col(actual).cast("string"), F.lit(MISSING_CAT))
    return out.withColumns({"match": F.coalesce(F.col("pred_label") == actual_label, F.lit(False)),
                            "match_code": F.coalesce(F.col(pred_code) == F.col("actual_code"), F.lit(False))})


def constraint_report(df: DataFrame, ns: str, ew: str, session: str, row_tol: float = 1e-10, mean_tol: float = 1e-6) -> DataFrame:
    """M6: one row of whether both sides' shares add up to 1 in every row and average 0.5 in every session.

    Two partial aggregates (sessions, then all), so no session is held in one task.  Without rows the errors are null and
    nothing is violated.
    """
    per = df.groupBy(session).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.abs(F.col(ns) + F.col(ew) - 1)).alias("_row"),
        F.sum(ns).alias("_ns"), F.sum(ew).alias("_ew"), F.greatest(F.abs(F.avg(ns) - 0.5), F.abs(F.avg(ew) - 0.5)).alias("_dev"))
    out = per.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("sessions"),
        F.max("_row").alias("max_row_sum_error"), F.max("_dev").alias("max_session_dev"),
        F.count_if(F.col("_row") >= row_tol).alias("sessions_with_bad_rows"), F.count_if(F.col("_dev") >= mean_tol).alias("sessions_off_mean"),
        F.try_divide(F.sum("_ns"), F.sum("_n")).alias("ns_mean"), F.try_divide(F.sum("_ew"), F.sum("_n")).alias("ew_mean"))
    return out.withColumns({"row_sums_ok": F.col("sessions_with_bad_rows") == 0, "session_means_ok": F.col("sessions_off_mean") == 0})


def error_metrics(df: DataFrame, pred: str, actual: str, by: str | None = None) -> DataFrame:
    """RMSE, MAE and R^2 (1 - SSE / SST, SST about the group mean) per group and overall."""
    def one(d: DataFrame, key: str | None) -> DataFrame:
        ks = [key] if key else []
        means = d.groupBy(*ks).agg(F.avg(actual).alias("_ybar"))
        j = d.join(means, on=ks, how="inner") if ks else d.crossJoin(F.broadcast(means))  # one row
        e = F.col(pred) - F.col(actual)
        g = j.groupBy(*ks).agg(
            F.count(e).alias("n"),
            F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
            F.round(F.avg(F.abs(e)), 6).alias("mae"),
            F.round(1 - F.try_divide(F.sum(e * e), F.sum(F.pow(F.col(actual) - F.col("_ybar"), 2))), 6).alias("r2"),
        )
        if not ks and by:
            g = g.withColumn(by, F.lit(None).cast(d.schema[by].dataType))
        return g

    if by is None:
        return one(df, None)
    return one(df, by).unionByName(one(df, None))
