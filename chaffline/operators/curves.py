"""From run results to retention curves, fits and conclusions.

Input runs have one row per (method, percent_removed, seed). Only the first aggregate reads
them; everything after it works on one row per method and budget. Budgets are compared as the
integer `percent_removed`, retention is for output.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chaffline.functions.numeric import nan_to_null, one_decimal, ratio
from chaffline.session import cut_lineage

RUN_SCHEMA = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("percent_removed", T.IntegerType()),
        T.StructField("seed", T.LongType()),
        T.StructField("best_val_acc", T.DoubleType()),
        T.StructField("best_val_loss", T.DoubleType()),
        T.StructField("test_acc", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Metric:
    """A curve column with its deviation, and which way is better."""

    column: str
    deviation: str
    higher_is_better: bool


# The metric each kind of task is judged by, and the extra curve of the first.
METRICS = {
    "accuracy": Metric("test_acc_mean", "test_acc_std", True),
    "loss": Metric("val_loss_mean", "val_loss_std", False),
}
VALIDATION_ACCURACY = Metric("val_acc_mean", "val_acc_std", True)

# Substitute for a zero baseline, largest drop that counts as safe, curve points.
ZERO_BASELINE = 1e-8
SAFE_DROP = 2.0
CURVE_POINTS = 200


def primary_metric(task: str) -> Metric:
    """The metric by task: validation loss for `loss`, else test accuracy."""
    return METRICS["loss" if task == "loss" else "accuracy"]


def aggregate_curves(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation of the three metrics over seeds, per method and budget."""
    measures = {"val_acc": "best_val_acc", "val_loss": "best_val_loss", "test_acc": "test_acc"}
    columns: list[Column] = []
    for name, column in measures.items():
        value = nan_to_null(column)
        columns += [F.avg(value).alias(f"{name}_mean"), F.stddev_samp(value).alias(f"{name}_std")]
    return (
        runs.dropna(subset=["method", "percent_removed"])
        .groupBy("method", "percent_removed")
        .agg(*columns, F.count("seed").alias("n_seeds"))
        .withColumn("retention", F.lit(1.0) - F.col("percent_removed") / 100.0)
    )


def crop_curves(curves: DataFrame, percentiles: Sequence[int]) -> DataFrame:
    """Rows of the given budgets; an error that lists the available ones if there are none."""
    cropped = curves.filter(F.col("percent_removed").isin([int(p) for p in percentiles]))
    if cropped.isEmpty():
        available = sorted(r[0] for r in curves.select("percent_removed").distinct().collect())
        raise ValueError(f"no rows for budgets {sorted(percentiles)}; available: {available}")
    return cropped


def retention_bands(curves: DataFrame, metric: Metric) -> DataFrame:
    """(method, retained_pct, value, lower, upper): the curve with one deviation either side."""
    deviation = F.coalesce(nan_to_null(metric.deviation), F.lit(0.0))
    value = F.col(metric.column)
    return curves.select(
        "method",
        "percent_removed",
        (F.col("retention") * 100).alias("retained_pct"),
        value.alias("value"),
        (value - deviation).alias("lower"),
        (value + deviation).alias("upper"),
    )


# The fit ----------------------------------------------------------------------------------

# Exponents tried: every hundredth in [-20, 20], then every ten-thousandth around the best.
_LARGEST_EXPONENT = 20
_COARSE = 100
_FINE = 10_000


def _regressions(points: DataFrame, exponents: Column) -> DataFrame:
    """(method, b, a, c, r2): least squares of the metric on retention^b, for each b."""
    tried = points.withColumn("b", F.explode(exponents)).filter(F.col("b") != 0)
    x = F.pow("retention", F.col("b"))
    return tried.groupBy("method", "b").agg(
        F.regr_slope(F.col("y"), x).alias("a"),
        F.regr_intercept(F.col("y"), x).alias("c"),
        F.regr_r2(F.col("y"), x).alias("r2"),
    )


def _best_fit(fits: DataFrame) -> DataFrame:
    usable = fits.filter(F.col("r2").isNotNull() & ~F.isnan("r2"))
    best = F.max_by(F.struct("a", "b", "c", "r2"), F.struct("r2", "b"))
    return usable.groupBy("method").agg(best.alias("fit")).select("method", "fit.*")


def fit_scaling_law(curves: DataFrame, metric: Metric) -> DataFrame:
    """(method, a, b, c, r2, at_bound): metric = a * retention^b + c by least squares.

    For a given b the fit is linear, so b is searched on a grid and refined once. NaN where a
    method has fewer than 3 points or a metric without variance. `at_bound` marks an exponent
    at the edge of the grid.
    """
    points = curves.select(
        "method", "retention", nan_to_null(metric.column).alias("y")
    ).dropna()
    varied = points.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("low"), F.max("y").alias("high")
    ).filter("n >= 3 and high > low")
    fitted = points.join(varied.select("method"), "method", "left_semi")

    def grid(low: Column, high: Column, parts: int) -> Column:
        return F.transform(F.sequence(low, high), lambda i: i / F.lit(float(parts)))

    edge = _LARGEST_EXPONENT * _COARSE
    coarse = _best_fit(_regressions(fitted, grid(F.lit(-edge), F.lit(edge), _COARSE)))
    step = _FINE // _COARSE
    centre = F.round(F.col("_near") * _FINE).cast("int")
    limit = _LARGEST_EXPONENT * _FINE
    fine = _best_fit(
        _regressions(
            fitted.join(coarse.select("method", F.col("b").alias("_near")), "method"),
            grid(
                F.greatest(centre - step, F.lit(-limit)), F.least(centre + step, F.lit(limit)), _FINE
            ),
        )
    )
    nan = F.lit(float("nan"))
    return (
        curves.select("method")
        .distinct()
        .join(fine, "method", "left")
        .select(
            "method",
            *[F.coalesce(c, nan).alias(c) for c in ("a", "b", "c", "r2")],
            F.coalesce(F.abs("b") >= _LARGEST_EXPONENT, F.lit(False)).alias("at_bound"),
        )
    )


def scaling_law_curve(curves: DataFrame, fits: DataFrame) -> DataFrame:
    """(method, point, retained_pct, value): the fit between smallest and largest retention."""
    spans = curves.groupBy("method").agg(
        F.min("retention").alias("low"),
        F.max("retention").alias("high"),
        F.count(F.lit(1)).alias("n"),
    )
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / F.lit(CURVE_POINTS - 1)
    return (
        spans.filter("n >= 2")
        .join(fits.filter(~F.isnan("r2")), "method")
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(CURVE_POINTS - 1))))
        .withColumn("x", x)
        .select(
            "method",
            "point",
            (F.col("x") * 100).alias("retained_pct"),
            (F.col("a") * F.pow("x", F.col("b")) + F.col("c")).alias("value"),
        )
    )


# Comparison with the full data --------------------------------------------------------------

def _baseline(metric: Metric) -> Column:
    """The method's own value on the full data, NULL where it has none."""
    full = F.when(F.col("percent_removed") == 0, F.col(metric.column))
    return F.max(full).over(Window.partitionBy("method"))


def relative_performance(curves: DataFrame, metric: Metric) -> DataFrame:
    """(method, percent_removed, relative_pct): value over own baseline, in percent.

    Without a full-data row the best value is the baseline; a zero baseline becomes tiny.
    """
    extreme = F.max if metric.higher_is_better else F.min
    best = extreme(nan_to_null(metric.column)).over(Window.partitionBy("method"))
    baseline = F.coalesce(_baseline(metric), best)
    baseline = F.when(baseline == 0, F.lit(ZERO_BASELINE)).otherwise(baseline)
    return curves.select(
        "method",
        "percent_removed",
        (F.col(metric.column) / baseline * 100).alias("relative_pct"),
    )


def method_budget_matrix(
    curves: DataFrame, metric: Metric, percentiles: Sequence[int]
) -> DataFrame:
    """One row per method, one column `pNN` per budget, NaN where there is no run."""
    wide = (
        curves.groupBy("method")
        .pivot("percent_removed", [int(p) for p in percentiles])
        .agg(F.first(metric.column))
    )
    return wide.select(
        "method",
        *[
            F.coalesce(F.col(str(p)), F.lit(float("nan"))).alias(f"p{int(p):02d}")
            for p in percentiles
        ],
    )


def _drop(value: Column, baseline: Column, metric: Metric) -> Column:
    """Loss of performance against the baseline in percent, NULL for a zero baseline."""
    relative = ratio(value, baseline)
    return (F.lit(1.0) - relative if metric.higher_is_better else relative - F.lit(1.0)) * 100


def efficiency_points(curves: DataFrame, metric: Metric) -> DataFrame:
    """(method, percent_removed, data_saved_pct, drop_pct) for budgets below the full data."""
    with_baseline = curves.withColumn("_baseline", _baseline(metric))
    return with_baseline.filter("percent_removed <> 0 and _baseline <> 0").select(
        "method",
        "percent_removed",
        ((F.lit(1.0) - F.col("retention")) * 100).alias("data_saved_pct"),
        _drop(F.col(metric.column), F.col("_baseline"), metric).alias("drop_pct"),
    )


def budget_analysis(curves: DataFrame, metric: Metric) -> DataFrame:
    """Per method with a full-data row: value, share of the baseline and drop, both rounded.

    For a loss the share is baseline over value. NaN where the divisor is 0.
    """
    value, baseline = F.col(metric.column), F.col("baseline_value")
    share = ratio(value, baseline) if metric.higher_is_better else ratio(baseline, value)
    nan = F.lit(float("nan"))
    return (
        curves.withColumn("baseline_value", _baseline(metric))
        .filter("baseline_value is not null")
        .select(
            "method",
            "percent_removed",
            (F.col("retention") * 100).alias("retention_pct"),
            "baseline_value",
            value.alias("metric_value"),
            F.coalesce(F.bround(share * 100, 2), nan).alias("relative_pct"),
            F.coalesce(F.bround(_drop(value, baseline, metric), 2), nan).alias("drop_pct"),
        )
    )


def safe_budgets(analysis: DataFrame) -> DataFrame:
    """(method, retention_pct, drop_pct): the smallest retention with a safe rounded drop.

    Methods without one keep a row of NULLs. A missing drop is not safe.
    """
    safe = (F.col("drop_pct") < SAFE_DROP) & ~F.isnan("drop_pct")
    found = F.struct("percent_removed", "retention_pct", "drop_pct")
    return (
        analysis.groupBy("method")
        .agg(F.max_by(F.when(safe, found), F.when(safe, F.col("percent_removed"))).alias("safe"))
        .select("method", "safe.percent_removed", "safe.retention_pct", "safe.drop_pct")
    )


def best_method_per_budget(curves: DataFrame, metric: Metric) -> DataFrame:
    """(percent_removed, method): the best method of each budget below the full data.

    Equal values go to the first method by name.
    """
    value = nan_to_null(metric.column)
    cost = -value if metric.higher_is_better else value
    return (
        curves.filter((F.col("percent_removed") != 0) & value.isNotNull())
        .groupBy("percent_removed")
        .agg(F.min_by("method", F.struct(cost.alias("cost"), "method")).alias("method"))
    )


# Text -------------------------------------------------------------------------------------

# The wording and number formats of the conclusions.
RULE = "=" * 70
TITLE = "QUANTITATIVE CONCLUSIONS — DATA EFFICIENCY ANALYSIS"
METRIC_LINE = "Metric: %s"
DIRECTION_LINE = "Direction: %s"
HIGHER = "higher is better"
LOWER = "lower is better"
METHOD_LINE = "--- %s ---"
BASELINE_LINE = "  Baseline (100%% data): %s"
LAW_LINE = "  Scaling law: %s = %s * retention^%s + %s"
R2_LINE = "  Scaling law R²: %s"
BUDGETS_LINE = "  Performance at each budget:"
BUDGET_LINE = "    %5.0f%% data → %s (%s%% of baseline, drop=%s%%)"
SAFE_LINE = "  Most aggressive safe budget (<2%% drop): %.0f%% data (drop=%s%%)"
NO_SAFE_LINE = "  No budget achieves <2% performance drop."
BEST_HEADING = "--- Best Method per Budget ---"
BEST_LINE = "  %.0f%% retention → %s"


def nice_name(method: Column) -> Column:
    return F.initcap(F.replace(method, F.lit("_"), F.lit(" ")))


def _number(pattern: str, value: Column) -> Column:
    """A number in the pattern, NaN spelled `nan`."""
    return F.when(F.isnan(value), "nan").otherwise(F.format_string(pattern, value))


def _short(value: Column) -> Column:
    """A number with up to four decimals, without needless zeros behind the first."""
    return F.regexp_replace(F.format_string("%.4f", value), r"(\.\d+?)0+$", "$1")


def _percent(value: Column) -> Column:
    return _number("%.1f", one_decimal(value))


def conclusion_lines(curves: DataFrame, metric: Metric, fits: DataFrame | None = None) -> DataFrame:
    """(section, ordinal, line): the conclusions as text, to be read in that order."""
    # Written out, a few rows each: every part of the text reads them.
    fits = cut_lineage(fit_scaling_law(curves, metric) if fits is None else fits)
    analysis = cut_lineage(budget_analysis(curves, metric))
    name = nice_name(F.col("method"))
    section = F.concat(F.lit("1 "), F.col("method"))

    def lines(frame: DataFrame, section: Column, ordinal: Column, line: Column) -> DataFrame:
        return frame.select(
            section.alias("section"), ordinal.cast("int").alias("ordinal"), line.alias("line")
        )

    spark = curves.sparkSession
    direction = HIGHER if metric.higher_is_better else LOWER
    heading = [RULE, TITLE, RULE, METRIC_LINE % metric.column, DIRECTION_LINE % direction, ""]
    head = spark.createDataFrame(
        [("0", i, line) for i, line in enumerate(heading)], "section string, ordinal int, line string"
    )
    tail = spark.createDataFrame(
        [("2", 0, BEST_HEADING), ("3", 0, RULE)], "section string, ordinal int, line string"
    )
    methods = (
        analysis.filter("percent_removed = 0").join(fits, "method", "left").withColumn("_name", name)
    )
    law = F.format_string(
        LAW_LINE,
        F.lit(metric.column),
        *[_number("%.4f", F.col(c)) for c in ("a", "b", "c")],
    )
    r2 = F.when(F.isnan("r2"), "nan").otherwise(_short(F.bround("r2", 4)))
    opening = F.array(
        F.format_string(METHOD_LINE, "_name"),
        F.format_string(BASELINE_LINE, _number("%.4f", F.col("baseline_value"))),
        law,
        F.format_string(R2_LINE, r2),
        F.lit(BUDGETS_LINE),
    )
    opened = methods.select("method", F.posexplode(opening).alias("_i", "_line"))
    budget = F.format_string(
        BUDGET_LINE,
        "retention_pct",
        _number("%.4f", F.col("metric_value")),
        _percent(F.col("relative_pct")),
        _percent(F.col("drop_pct")),
    )
    safe = F.when(F.col("retention_pct").isNull(), NO_SAFE_LINE).otherwise(
        F.format_string(SAFE_LINE, "retention_pct", _percent(F.col("drop_pct")))
    )
    best = best_method_per_budget(curves, metric)
    parts = [
        lines(opened, section, F.col("_i"), F.col("_line")),
        # Budgets run from the smallest retention to the full data.
        lines(analysis, section, F.lit(200) - F.col("percent_removed"), budget),
        lines(safe_budgets(analysis), section, F.lit(300), safe),
        lines(analysis.select("method").distinct(), section, F.lit(301), F.lit("")),
        tail,
        lines(
            best,
            F.lit("2"),
            F.lit(200) - F.col("percent_removed"),
            F.format_string(BEST_LINE, (F.lit(100) - F.col("percent_removed")).cast("double"), name),
        ),
    ]
    for part in parts:
        head = head.unionByName(part)
    return head
