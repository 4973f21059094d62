"""Evaluation, diagnostics, registry, training and reports."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from checks.views import SEQUENCE_COLUMNS, Tables, band, sql
from tillcast.functions import calendar
from tillcast.operators import diagnose, evaluate, registry, report, windows
from tillcast.operators.split import split_chrono
from tillcast.plans import batch, training

MEASURES = ["rmse", "mae", "mape", "mae_x100", "r2"]


def rounded(df, columns, digits=3):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def metrics_regression(t: Tables):
    return rounded(evaluate.regression_metrics(t.predictions), MEASURES)


def model_weights(t: Tables):
    metrics = evaluate.regression_metrics(t.predictions.filter(F.col("model") != "ensemble"))
    return evaluate.ensemble_weights(metrics)


def store_weights(t: Tables):
    wide = t.store_metrics.filter((F.col("model") != "ensemble") & (F.col("metric") == "r2"))
    return evaluate.ensemble_weights(
        wide.select("store_id", "model", F.col("value").alias("r2")), ["store_id"]
    )


def ensemble_weights(t: Tables):
    return rounded(store_weights(t), ["weight"], 9)


WEIGHTS_SQL = """select store_id, model, raw / sum(raw) over (partition by store_id) as weight
    from (select *, greatest(0.2::double, coalesce(score / nullif(sum(score) over
            (partition by store_id), 0), 1.0::double / count(*) over (partition by store_id))) as raw
          from (select store_id, model, greatest(value, 0.0) as score from {store_metrics}
                where model <> 'ensemble' and metric = 'r2'))"""


def ensemble_predict(t: Tables):
    single = t.predictions.filter(F.col("model") != "ensemble")
    return evaluate.ensemble_predict(
        single, store_weights(t), ("date", "store_id"), ("store_id", "model")
    )


def ensemble_simple(t: Tables):
    return evaluate.ensemble_predict(t.predictions.filter(F.col("model") != "ensemble"))


def side(t: Tables, model: str):
    return t.store_metrics.filter(F.col("model") == model).drop("model")


def comparison(t: Tables):
    return registry.compare_metrics(side(t, "model_a"), side(t, "model_b"), ["store_id"])


COMPARE_SQL = """select store_id, metric, p.value as production, c.value as candidate,
    case when metric = 'r2' then (c.value - p.value) / nullif(abs(p.value), 0)
      else (p.value - c.value) / nullif(p.value, 0) end * 100 as improvement,
    case when metric = 'r2' then c.value > p.value else c.value < p.value end as is_better,
    case when metric = 'r2' then 'higher' else 'lower' end as direction
    from (select * from {store_metrics} where model = 'model_a') p
    join (select * from {store_metrics} where model = 'model_b') c using (store_id, metric)
    where metric in ('rmse', 'mae', 'r2')"""
COUNTED_SQL = f"""select *, coalesce(is_better and abs(improvement / 100) >= 0.01, false) as counted
    from ({COMPARE_SQL})"""


def promote_decision(t: Tables):
    names = t.store_metrics.select("store_id").distinct()
    deployed = names.filter(F.col("store_id") % 5 != 0)
    return registry.promote_decision(names, comparison(t), deployed, ["store_id"])


def promote_first(t: Tables):
    names = t.store_metrics.select("store_id").distinct()
    deployed = names.filter(F.col("store_id") % 5 != 0)
    return registry.promote_decision(
        names, comparison(t), deployed, ["store_id"], force_first_deployment=True
    )


def _promote_sql(first: str, first_reason: str) -> str:
    return f"""select store_id, case when store_id % 5 = 0 then {first} else ok end as promoted,
        case when store_id % 5 = 0 then '{first_reason}'
          when ok then 'Improved on ' || improved || ' out of ' || compared || ' metrics'
          else 'Performance not improved sufficiently' end as reason
        from (select store_id, count(*) filter (counted) as improved, count(*) as compared,
          count(*) filter (metric in ('rmse', 'mae')) > 0
            and count(*) filter (metric in ('rmse', 'mae') and not counted) = 0 as ok
          from ({COUNTED_SQL}) group by store_id)"""


def transition_stage(t: Tables):
    newest = t.model_versions.groupBy("name").agg(F.max("version").alias("version"))
    return registry.transition_stage(t.model_versions, newest)


def holdout_validate(t: Tables):
    made = evaluate.holdout_validate(t.predictions)
    return rounded(made, ["validation_rmse", "validation_mae", "validation_r2"])


def sample_seeded(t: Tables):
    return evaluate.sample_seeded(t.daily, ["date", "store_id"])


def outliers_iqr(t: Tables):
    made = diagnose.outliers_iqr(t.daily_split, "sales", ["split"])
    return rounded(made, ["lower_bound", "upper_bound", "share"], 8)


OUTLIERS_SQL = """select split, round(lo, 8) as lower_bound, round(hi, 8) as upper_bound,
    count(*) filter (sales < lo or sales > hi) as outliers,
    round(count(*) filter (sales < lo or sales > hi) / count(*)::double, 8) as share,
    min(sales) filter (sales < lo or sales > hi) as min_outlier,
    max(sales) filter (sales < lo or sales > hi) as max_outlier
    from {daily_split} join (select split, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
      from (select split, quantile_cont(sales, 0.25) as q1, quantile_cont(sales, 0.75) as q3
            from {daily_split} group by split)) using (split) group by split, lo, hi"""


def dist_shift(t: Tables):
    made = diagnose.dist_shift(t.daily_split, "sales")
    return rounded(rounded(made, ["mean", "std"]), ["mean_shift"], 6)


def pred_extremes(t: Tables):
    made = diagnose.pred_extremes(t.prediction_stage)
    return rounded(made, ["pred_mean", "pred_std", "residual_mean", "residual_std", "mape"])


LEAKY = ["quantity_sold", "profit", "has_promotion", "customer_traffic"]


def leakage_corr(t: Tables):
    train = split_chrono(t.store_day_stage).filter(F.col("split") == "train")
    return rounded(diagnose.leakage_corr(train, LEAKY, "sales"), ["corr"], 6)


def zero_target(t: Tables):
    # the promotion flag is the target with many empty days
    flagged = t.daily_split.withColumn("target", F.coalesce("has_promotion", F.lit(0.0)))
    return diagnose.zero_target(flagged, "target")


def diagnosis_report(t: Tables):
    data = split_chrono(t.store_day_stage)
    made = diagnose.diagnosis_report(data, t.prediction_stage, "sales", LEAKY)
    return rounded(made, ["value"], 3)


def variance_topk(t: Tables):
    columns = ["sales", "quantity_sold", "profit", "customer_traffic", "has_promotion"]
    return rounded(diagnose.variance_topk(t.store_day, columns, 5), ["variance"], 1)


def topk_importance(t: Tables):
    return windows.top_k(t.importances, 3, ["model"], "importance", "feature")


def best_model(t: Tables):
    rmse = t.store_metrics.filter(F.col("metric") == "rmse").withColumnRenamed("value", "rmse")
    return registry.best_model(rmse, ["store_id"])


def overall_long(t: Tables):
    return evaluate.metrics_long(metrics_regression(t))


def prefixed(t: Tables):
    """Names such as model_a_rmse in one column, as a run logs them."""
    logged = overall_long(t).select(
        F.concat_ws("_", "model", "metric").alias("metric"), "value"
    )
    return report.prefixed_metrics(logged, ["model_a", "model_b", "ensemble"])


def report_residuals(t: Tables):
    return report.residual_table(t.prediction_stage)


def report_boxplot(t: Tables):
    made = report.boxplot_table(report_residuals(t))
    return rounded(made, ["q1", "median", "q3"], 6)


def report_qq(t: Tables):
    made = report.qq_table(report_residuals(t), ["date", "store_id"])
    return rounded(made, ["theoretical_quantile"], 6)


def report_predictions(t: Tables):
    return report.prediction_table(t.predictions)


def _poly(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r})::double)"
    return out


def _tail(p: str) -> str:
    x = f"sqrt(-2.0::double * ln({p}))"
    return f"({_poly(report.ACKLAM_C, x)}) / (({_poly(report.ACKLAM_D, x)}) * {x} + 1.0::double)"


_R = "((p - 0.5) * (p - 0.5))"
_CENTRE = (
    f"({_poly(report.ACKLAM_A, _R)}) * (p - 0.5) / (({_poly(report.ACKLAM_B, _R)}) * {_R} + 1.0::double)"
)
QQ_SQL = f"""select model, date, store_id, rank, sample_quantile,
    round(case when p < 0.02425 then {_tail('p')} when p > 0.97575 then -{_tail('(1.0::double - p)')}
      else {_CENTRE} end, 6) as theoretical_quantile
    from (select *, case when rank = n then pow(0.5::double, 1.0::double / n)
        when rank = 1 then 1.0::double - pow(0.5::double, 1.0::double / n)
        else (rank - 0.3175::double) / (n + 0.365::double) end as p
      from (select model, date, store_id, residual as sample_quantile,
        row_number() over (partition by model order by residual, date, store_id) as rank,
        count(*) over (partition by model) as n from {{residuals}}))"""

METRICS_SQL = """select model, round(rmse, 3) as rmse, round(mae, 3) as mae, round(mape, 3) as mape,
    round(mae_x100, 3) as mae_x100, round(r2, 3) as r2, n from (
    select model, sqrt(avg((actual - prediction) ** 2)) as rmse,
        avg(abs(actual - prediction)) as mae,
        avg(case when actual <> 0 then abs(actual - prediction) / abs(actual) end) * 100 as mape,
        avg(abs(actual - prediction)) * 100 as mae_x100,
        1 - avg((actual - prediction) ** 2) / nullif(var_pop(actual), 0) as r2, count(*) as n
    from {predictions} group by model)"""
LONG_SQL = f"""select model, metric, value from (unpivot (select model, rmse, mae, mape, mae_x100, r2
    from ({METRICS_SQL})) on rmse, mae, mape, mae_x100, r2 into name metric value value)"""
SHIFT_SQL = """select s.split, s.mean, s.std, s.n,
    abs(s.mean - t.mean) / greatest(abs(t.mean), t.std, 1e-8) as mean_shift
    from (select split, avg(sales) as mean, stddev_samp(sales) as std, count(sales) as n
          from {daily_split} group by split) s,
         (select avg(sales) as mean, stddev_samp(sales) as std from {daily_split}
          where split = 'train') t"""
EXTREMES_SQL = """select model, avg(prediction) as pred_mean, stddev_pop(prediction) as pred_std,
    count(*) filter (prediction < lo * 0.5) as extreme_low,
    count(*) filter (prediction > hi * 1.5) as extreme_high,
    avg(actual - prediction) as residual_mean, stddev_pop(actual - prediction) as residual_std,
    avg(case when actual <> 0 then abs((actual - prediction) / actual) end) * 100 as mape
    from {predictions}, (select min(actual) as lo, max(actual) as hi from {predictions})
    group by model"""
CORR_SQL = """select feature, case when not isnan(corr) then corr end as corr from (unpivot (select corr(quantity_sold, sales) as quantity_sold,
    corr(profit, sales) as profit, corr(has_promotion, sales) as has_promotion,
    corr(customer_traffic, sales) as customer_traffic from {store_day}
    join (select date, store_id, split from {daily_split}) using (date, store_id)
    where split = 'train') on quantity_sold, profit, has_promotion, customer_traffic
    into name feature value corr)"""


def _report_part(check, subject, value, flagged, message, source):
    return f"""select '{check}' as "check", {subject} as subject, round(({value})::double, 3) as value,
        {flagged} as flagged, case when {flagged} then '{message}' end as message from ({source})"""


_SIZES = "select split, count(*) as n, count(*) filter (sales = 0) as zeros from {daily_split} group by split"
DIAGNOSIS_SQL = " union all ".join([
    _report_part("outliers", "split", "share", "false", "", OUTLIERS_SQL),
    _report_part("outlier_lower_bound", "split", "lower_bound", "false", "", OUTLIERS_SQL),
    _report_part("outlier_upper_bound", "split", "upper_bound", "false", "", OUTLIERS_SQL),
    _report_part("distribution_shift", "split", "mean_shift", "mean_shift > 0.2",
                 "significant distribution shift against train", SHIFT_SQL),
    *[
        _report_part(figure, "model", figure, "false", "", EXTREMES_SQL)
        for figure in ["pred_mean", "pred_std", "residual_mean", "residual_std", "mape",
                       "extreme_low", "extreme_high"]
    ],
    _report_part("leakage", "feature", "corr", "coalesce(abs(corr) > 0.95, false)",
                 "potential data leakage", "select f.feature, c.corr from (values ('quantity_sold'), "
                 "('profit'), ('has_promotion'), ('customer_traffic')) f(feature) left join "
                 f"({CORR_SQL}) c using (feature)"),
    _report_part("zero_target", "split", "zeros / n::double", "zeros > n * 0.1",
                 "many zero values in training", _SIZES + " having split = 'train'"),
    _report_part("sample_size", "split", "n", "split = 'train' and n <= 1000",
                 "small training set", _SIZES),
    _report_part("feature_count", "split", "4", "false", "", _SIZES + " having split = 'train'"),
])


# --- learners: what does not depend on the learner's numbers ---


def prepared(t: Tables):
    """Preprocessed vectors, made by each query for itself."""
    if not hasattr(t, "_prepared"):
        t._prepared = training.preprocess(t.features)
    return t._prepared


def assemble_xy(t: Tables):
    rows = prepared(t).rows
    values = vector_to_array("features")
    return rows.select(
        "date", "store_id", "split", "label", F.size(values).alias("n_features"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 6).alias("feature_sum"),
    )


def finite(column: str):
    return F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def _scored(model, t: Tables):
    test = prepared(t).rows.filter(F.col("split") == "test")
    return model.transform(test).select(
        "date", "store_id", F.col("label").alias("actual"), finite("prediction").alias("finite"),
        F.lit(model.getNumTrees).alias("trees"),
    )


def train_gbt(t: Tables):
    return _scored(training.train_gbt(prepared(t).rows), t)


def train_second(t: Tables):
    return _scored(training.train_second(prepared(t).rows), t)


def _scored_sql(trees: int) -> str:
    return sql(f"""select date, store_id, sales as actual, true as finite, {trees} as trees
        from {{daily_split}} where split = 'test'""")


def tune_search(t: Tables):
    """All fits of the race of both learners over their full ranges, with their real scores."""
    rows = prepared(t).rows
    with ThreadPool(2) as pool:  # one learner's last fits fill the cores that the other leaves idle
        made = pool.map(lambda name: training.tune_search(rows, name), training.LEARNERS)
    return made[0].unionByName(made[1]).withColumn("params", F.map_entries("params"))


def feature_importance(t: Tables):
    p = prepared(t)
    models = {"boosted": training.train_gbt(p.rows), "forest": training.train_second(p.rows)}
    made = training.feature_importance(models, p.features, t.spark)
    total = F.sum("importance").over(Window.partitionBy("model"))
    return made.select(
        "model", "feature", F.col("importance").between(0, 1).alias("share"), F.round(total, 6).alias("total")
    )


def trained(t: Tables):
    """Both learners at their own settings; the search has a query of its own."""
    return training.train_pipeline(t.features, trials=0)


def train_pipeline(t: Tables):
    made = trained(t).metrics
    good = F.lit(True)
    for name in MEASURES:
        good = good & finite(name)
    return made.select("model", "n", good.alias("finite"), (F.col("rmse") >= F.col("mae")).alias("ordered"))


def batch_predict(t: Tables):
    accepted, _ = calendar.split_requests(t.requests)
    model = trained(t)
    made = batch.batch_predict(
        accepted.select("store_id", "request_date"), t.daily, t.holidays,
        model.prepared, model.models, model.weights,
    )
    def near(bound, z):
        return F.abs(F.col(bound) - (F.col("prediction") + z * 0.1 * F.col("prediction"))) <= 0.0101

    bands = near("lower_80", -1.28) & near("upper_80", 1.28) & near("lower_95", -1.96) & near("upper_95", 1.96)
    return made.select("store_id", "date", "model", "model_version", bands.alias("bands"))


VECTOR_COLUMNS = [
    "store_id", "has_promotion", "year", "month", "day", "dayofweek", "quarter", "weekofyear",
    "is_weekend", "is_holiday", *SEQUENCE_COLUMNS,
    *[f"{n}_{f}" for n in ["day", "month", "dayofweek"] for f in ["sin", "cos"]],
]
_NUMERIC = ", ".join(f"cast({c} as double) as {c}" for c in VECTOR_COLUMNS)
_FIT = ", ".join(
    f"avg({c}) as {c}_m, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as {c}_s"
    for c in VECTOR_COLUMNS
)
_SUM = " + ".join(f"coalesce(({c} - {c}_m) / {c}_s, 0)" for c in VECTOR_COLUMNS)
ASSEMBLE_SQL = f"""with_split as (select date, store_id as store, split, sales as label, {_NUMERIC}
      from {{features}} join (select date, store_id, split from {{daily_split}}) using (date, store_id)),
    fitted as (select {_FIT} from with_split where split = 'train')
    select date, store as store_id, split, label, {len(VECTOR_COLUMNS)}::int as n_features,
      round({_SUM}, 6) as feature_sum from with_split, fitted"""


def _assemble_sql() -> str:
    # the views come first in the same WITH clause
    text = sql(ASSEMBLE_SQL)
    views, rest = text.split("\nwith_split as", 1)
    return f"{views},\nwith_split as{rest}"


QUERIES = {
    "metrics_regression": (metrics_regression, sql(METRICS_SQL)),
    "ensemble_weights": (ensemble_weights, sql(
        f"select store_id, model, round(weight, 9) as weight from ({WEIGHTS_SQL})")),
    "ensemble_predict": (ensemble_predict, sql(f"""select date, store_id,
        sum(weight * prediction) / sum(weight) as prediction
        from {{predictions}} join ({WEIGHTS_SQL}) using (store_id, model) group by date, store_id""")),
    "ensemble_simple": (ensemble_simple, sql(
        "select date, store_id, (a + b) / 2.0::double as prediction from {naive} where a is not null")),
    "compare_metrics": (
        lambda t: rounded(comparison(t), ["improvement"], 6),
        sql(f"select * replace (round(improvement, 6) as improvement) from ({COUNTED_SQL})")),
    "promote_decision": (promote_decision, sql(
        _promote_sql("false", "No production model to compare against"))),
    "promote_first_deployment": (promote_first, sql(_promote_sql("true", "First deployment"))),
    "transition_stage": (transition_stage, sql("""select name, version, run_id,
        case when version = max(version) over (partition by name) then 'Production'
          when stage = 'Production' then 'Archived' else stage end as stage
        from {model_versions}""")),
    "sample_seeded": (sample_seeded, sql("""select * from {daily}
        order by md5(strftime(date, '%Y-%m-%d') || '|' || store_id || '|42'), date, store_id
        limit 1000""")),
    "holdout_validate": (holdout_validate, sql("""select model,
        round(sqrt(avg((actual - prediction) ** 2)), 3) as validation_rmse,
        round(avg(abs(actual - prediction)), 3) as validation_mae,
        round(1 - avg((actual - prediction) ** 2) / var_pop(actual), 3) as validation_r2,
        count(*) as validation_samples from {predictions} group by model""")),
    "outliers_iqr": (outliers_iqr, sql(OUTLIERS_SQL)),
    "dist_shift": (dist_shift, sql(f"""select split, round(mean, 3) as mean, round(std, 3) as std, n,
        round(mean_shift, 6) as mean_shift, mean_shift > 0.2 as flagged from ({SHIFT_SQL})""")),
    "pred_extremes": (pred_extremes, sql(f"""select * replace (round(pred_mean, 3) as pred_mean,
        round(pred_std, 3) as pred_std, round(residual_mean, 3) as residual_mean,
        round(residual_std, 3) as residual_std, round(mape, 3) as mape) from ({EXTREMES_SQL})""")),
    "leakage_corr": (leakage_corr, sql(f"""select feature, round(corr, 6) as corr,
        coalesce(abs(corr) > 0.95, false) as flagged from (values ('quantity_sold'), ('profit'),
        ('has_promotion'), ('customer_traffic')) f(feature) left join ({CORR_SQL}) using (feature)""")),
    "zero_target": (zero_target, sql("""select split,
        count(*) filter (coalesce(has_promotion, 0) = 0) as zeros, count(*) as n,
        count(*) filter (coalesce(has_promotion, 0) = 0) > count(*) * 0.1 as flagged
        from {daily_split} group by split""")),
    "sample_size": (
        lambda t: diagnose.sample_size(t.daily_split),
        sql("""select split, count(*) as n, split = 'train' and count(*) <= 1000 as flagged
        from {daily_split} group by split""")),
    "diagnosis_report": (diagnosis_report, sql(DIAGNOSIS_SQL)),
    "variance_topk": (variance_topk, sql("""select feature, round(variance, 1) as variance from (
        unpivot (select var_samp(sales) as sales, var_samp(quantity_sold) as quantity_sold,
          var_samp(profit) as profit, var_samp(customer_traffic) as customer_traffic,
          var_samp(has_promotion) as has_promotion from {store_day})
        on sales, quantity_sold, profit, customer_traffic, has_promotion
        into name feature value variance) where variance > 0 order by variance desc limit 5""")),
    "topk_importance": (topk_importance, sql("""select * from (select *, cast(row_number() over (
        partition by model order by importance desc, feature) as int) as rank from {importances})
        where rank <= 3""")),
    "best_model": (best_model, sql("""select store_id, arg_min(model, (value, model)) as best_model,
        min(value) as best_rmse from {store_metrics} where metric = 'rmse' group by store_id""")),
    "best_run": (
        lambda t: registry.best_run(t.runs),
        sql("select * from {runs} where value is not null order by value, run_id limit 1")),
    "best_per_metric": (
        lambda t: registry.best_per_metric(t.store_metrics, ["store_id"]),
        sql("""select store_id, metric, model, value from (select *, row_number() over (
        partition by store_id, metric order by case when metric = 'r2' then -value else value end, model)
        as rn from {store_metrics}) where rn = 1""")),
    "latest_version": (
        lambda t: registry.latest_version(t.model_versions, t.runs),
        sql("""select name, 'Production' as stage,
        coalesce(cast(max(version) filter (stage = 'Production') as varchar), min(fallback)) as version,
        coalesce(arg_max(run_id, version) filter (stage = 'Production'), min(fallback)) as run_id
        from {model_versions} join (select name, arg_min(run_id, (value, run_id)) as fallback
          from {runs} group by name) using (name) group by name""")),
    "report_metrics": (
        lambda t: report.metrics_table(prefixed(t)),
        sql(f"""select model, rmse, mae, mape, r2, rmse = min(rmse) over () as best_rmse,
        mae = min(mae) over () as best_mae, mape = min(mape) over () as best_mape,
        model = arg_min(model, (-r2, model)) over () as best_r2 from ({METRICS_SQL})""")),
    "report_predictions": (report_predictions, sql("""select model, date, store_id, actual, prediction,
        """ + f"{band('-', '1.96')} as prediction_lower, {band('+', '1.96')} as prediction_upper"
        + " from {predictions}")),
    "report_residuals": (report_residuals, sql("select * from {residuals}")),
    "report_boxplot": (report_boxplot, sql("""select model, round(q1, 6) as q1, round(m, 6) as median,
        round(q3, 6) as q3,
        min(residual) filter (residual >= q1 - 1.5 * (q3 - q1)) as whisker_low,
        max(residual) filter (residual <= q3 + 1.5 * (q3 - q1)) as whisker_high,
        count(*) filter (residual < q1 - 1.5 * (q3 - q1) or residual > q3 + 1.5 * (q3 - q1)) as outliers
        from {residuals} join (select model, quantile_cont(residual, 0.25) as q1,
          quantile_cont(residual, 0.5) as m, quantile_cont(residual, 0.75) as q3
          from {residuals} group by model) using (model) group by model, q1, m, q3""")),
    "report_qq": (report_qq, sql(QQ_SQL)),
    "report_error_hist": (
        lambda t: report.error_histogram(report_residuals(t)),
        sql("""select model, bin, lo + bin * width as bin_start, count(*) as count,
        count(*)::double / (n * width) as density from (select model, lo, width, n,
          cast(least(floor((abs(residual) - lo) / width), 49) as int) as bin
          from {residuals} join (select model, min(abs(residual)) as lo, count(*) as n,
            (max(abs(residual)) - min(abs(residual))) / 50.0::double as width
            from {residuals} group by model) using (model)) group by model, bin, lo, width, n""")),
    "report_importance": (
        lambda t: report.importance_table(t.importances, 5),
        sql("""select * from (select *, cast(row_number() over (
        partition by model order by importance desc, feature) as int) as rank from {importances})
        where rank <= 5""")),
    "assemble_xy": (assemble_xy, _assemble_sql()),
    "train_gbt": (train_gbt, _scored_sql(100)),
    "train_second": (train_second, _scored_sql(100)),
    "tune_search": (tune_search, None),
    "feature_importance": (feature_importance, f"""select model, feature, true as share, 1.0::double as total
        from (values ('boosted'), ('forest')) m(model),
        (values {", ".join(f"('{c}')" for c in VECTOR_COLUMNS)}) f(feature)"""),
    "train_pipeline": (train_pipeline, sql("""select model, n, true as finite, true as ordered
        from (select count(*) as n from {daily_split} where split = 'test'),
        (values ('boosted'), ('forest'), ('ensemble')) m(model)""")),
    "batch_predict": (batch_predict, sql("""select store_id, date, model, 'v1' as model_version,
        true as bands from {requests}, (values ('boosted'), ('forest'), ('ensemble')) m(model)
        where regexp_matches(date, '^[0-9]+-[0-9]+-[0-9]+$')""")),
}
