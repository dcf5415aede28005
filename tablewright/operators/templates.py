"""Business analyses: customers (RFM, segments), sales and A/B tests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import labels, probability
from tablewright.operators import charts
from tablewright.operators.columns import require
from tablewright.operators.hypothesis import _pooled, group_statistics, two_groups
from tablewright.operators.quantiles import with_quantiles
from tablewright.operators.stats import descriptive
from tablewright.session import attach, beside, scalars

# --- customers -----------------------------------------------------------------------


def customer_facts(df: DataFrame, customer: str = "customer_id", amount: str = "purchase_amount", date: str = "purchase_date") -> DataFrame:
    return df.groupBy(F.col(customer).alias("customer_id")).agg(
        F.max(date).alias("last_purchase"),
        F.min(date).alias("first_purchase"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum(amount).alias("monetary"),
        F.avg(amount).alias("avg_purchase"),
    )


def _whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two times, whatever the session's time zone."""
    return F.extract(F.lit("DAY"), later - earlier).cast("long")


def quintile(value: Column, edges: Column, reverse: bool = False) -> Column:
    """Fifth of the distribution, right-closed, 3 for everyone if edges coincide."""
    order = (5, 4, 3, 2, 1) if reverse else (1, 2, 3, 4, 5)
    place = F.when(F.size(F.array_distinct(edges)) < 6, 3)
    for i in range(4):
        place = place.when(value <= edges[i + 1], order[i])
    return place.otherwise(order[4])


def rfm(df: DataFrame, customer: str = "customer_id", amount: str = "purchase_amount", date: str = "purchase_date") -> DataFrame:
    """Recency, frequency and monetary value with quintile scores and their sum."""
    facts = customer_facts(df, customer, amount, date)
    newest = df.agg(F.max(date).alias("newest"))
    table = attach(facts, newest).select(
        "customer_id", _whole_days(F.col("_s.newest"), F.col("last_purchase")).alias("recency"), "frequency", "monetary"
    )
    edges = with_quantiles(table, ["recency", "frequency", "monetary"], (0.0, 0.2, 0.4, 0.6, 0.8, 1.0))
    scored = attach(table, edges).select(
        "customer_id",
        "recency",
        "frequency",
        "monetary",
        quintile(F.col("recency"), F.col("_s.q_recency"), reverse=True).alias("r_score"),
        quintile(F.col("frequency"), F.col("_s.q_frequency")).alias("f_score"),
        quintile(F.col("monetary"), F.col("_s.q_monetary")).alias("m_score"),
    )
    return scored.withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def rfm_distribution(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rfm_score").agg(F.count(F.lit(1)).alias("customers"))


def segments(df: DataFrame, customer: str = "customer_id", amount: str = "purchase_amount", date: str = "purchase_date") -> DataFrame:
    """VIP, high, medium and low value customers by spending and count quantiles."""
    facts = customer_facts(df, customer, amount, date)
    cut = with_quantiles(facts, ["monetary", "frequency"], (0.5, 0.8))
    rich, usual, often = F.col("_s.q_monetary")[1], F.col("_s.q_monetary")[0], F.col("_s.q_frequency")[1]
    segment = (
        F.when((F.col("monetary") > rich) & (F.col("frequency") > often), "vip")
        .when(F.col("monetary") > rich, "high_value")
        .when(F.col("monetary") > usual, "medium_value")
        .otherwise("low_value")
    )
    return attach(facts, cut).select(
        "customer_id",
        F.col("monetary").alias("total_spent"),
        "avg_purchase",
        F.col("frequency").alias("purchase_count"),
        "first_purchase",
        "last_purchase",
        segment.alias("segment"),
    )


def segment_stats(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("total_spent").alias("total_spent_mean"),
        F.stddev_samp("total_spent").alias("total_spent_std"),
        F.avg("purchase_count").alias("purchase_count_mean"),
        F.stddev_samp("purchase_count").alias("purchase_count_std"),
    )


def purchase_patterns(df: DataFrame, by: str, customer: str = "customer_id", amount: str = "purchase_amount", date: str = "purchase_date") -> DataFrame:
    """Sum, mean, count and spread per month, weekday (Monday 0) or customer."""
    key = {"month": F.month(date), "weekday": F.weekday(date), "customer": F.col(customer)}[by]
    return df.groupBy(key.alias(by)).agg(
        F.sum(amount).alias("total"), F.avg(amount).alias("mean"), F.count(amount).alias("n"), F.stddev_samp(amount).alias("std")
    )


def customer_advice(scored: DataFrame, segmented: DataFrame) -> DataFrame:
    """Advice codes from the score distribution and the segment sizes."""
    few = scored.agg((F.count_if(F.col("rfm_score") >= 12) / F.count(F.lit(1)) < 0.2).alias("few_valuable"))
    many = segmented.agg(
        (F.count_if(F.col("segment") == "low_value") > F.count_if(F.col("segment") == "vip")).alias("many_low")
    )
    row = beside(few, many)
    codes = F.filter(
        F.array(F.when(F.col("few_valuable"), F.lit("strengthen_retention")), F.when(F.col("many_low"), F.lit("raise_customer_value"))),
        lambda c: c.isNotNull(),
    )
    return row.select(F.explode(codes).alias("advice"))


# --- sales -----------------------------------------------------------------------------


def monthly_sales(df: DataFrame, date: str = "sales_date", amount: str = "sales_amount") -> DataFrame:
    return df.groupBy(F.date_trunc("month", date).cast("date").alias("month")).agg(F.sum(amount).alias("total"))


def sales_trend(df: DataFrame, date: str = "sales_date", amount: str = "sales_amount") -> DataFrame:
    """Slope and fit of the monthly totals. Numbering runs over one row per month."""
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    rows = monthly_sales(df, date, amount).withColumn("i", F.row_number().over(w) - 1)
    slope = F.col("slope")
    return rows.agg(
        F.count(F.lit(1)).alias("months"), F.regr_slope("total", "i").alias("slope"), F.regr_r2("total", "i").alias("r2")
    ).withColumn("direction", F.when(slope > 0, "up").when(slope < 0, "down").otherwise("stable"))


def sales_seasonality(df: DataFrame, date: str = "sales_date", amount: str = "sales_amount") -> DataFrame:
    """Mean sale by month and quarter of the year, and its ratio to the overall mean."""
    total = df.select(F.month(date).alias("month"), F.quarter(date).alias("quarter"), F.col(amount).alias("a"))
    cells = total.groupBy("month", "quarter").agg(F.sum("a").alias("s"), F.count("a").alias("n"))
    mean = scalars(cells.agg((F.sum("s") / F.sum("n")).alias("m"))).getField("m")

    def part(kind: str) -> DataFrame:
        return cells.groupBy(F.col(kind).alias("period")).agg((F.sum("s") / F.sum("n")).alias("mean")).select(
            F.lit(kind).alias("kind"), "period", "mean", (F.col("mean") / mean).alias("seasonal_index")
        )

    return part("month").unionByName(part("quarter"))


def sales_by_category(df: DataFrame, category: str = "product_category", amount: str = "sales_amount") -> DataFrame:
    return df.groupBy(category).agg(
        F.sum(amount).alias("total"), F.avg(amount).alias("mean"), F.count(amount).alias("n"), F.stddev_samp(amount).alias("std")
    )


def sales_advice(df: DataFrame, date: str = "sales_date", amount: str = "sales_amount") -> DataFrame:
    """Direction advice, and the months to stock up and to promote in."""
    months = sales_seasonality(df, date, amount).filter("kind = 'month'")
    ends = months.agg(
        F.max_by("period", F.struct("seasonal_index", -F.col("period"))).alias("peak"),
        F.min_by("period", F.struct("seasonal_index", "period")).alias("low"),
    )
    row = beside(sales_trend(df, date, amount), ends)
    none = F.lit(None).cast("int")
    codes = F.filter(
        F.array(
            F.when(F.col("direction") == "down", F.struct(F.lit("review_marketing").alias("advice"), none.alias("month")))
            .when(F.col("direction") == "up", F.struct(F.lit("keep_strategy").alias("advice"), none.alias("month"))),
            F.struct(F.lit("stock_up").alias("advice"), F.col("peak").alias("month")),
            F.struct(F.lit("promote").alias("advice"), F.col("low").alias("month")),
        ),
        lambda c: c.isNotNull(),
    )
    return row.select(F.inline(codes))


# --- A/B -------------------------------------------------------------------------------


def ab_basic(df: DataFrame, group: str = "group", metric: str = "metric") -> DataFrame:
    return group_statistics(df, metric, group).select(group, "n", "mean", "std", "min", "max")


def ab_effect(df: DataFrame, group: str = "group", metric: str = "metric") -> DataFrame:
    """Effect size with the sign of (a - b), and the t statistic of the same row."""
    row = _pooled(two_groups(df, metric, group))
    d = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.col("pooled_std"))
    return row.select(
        "group_a",
        "group_b",
        "mean_a",
        "mean_b",
        (F.col("mean_a") - F.col("mean_b")).alias("difference"),
        d.alias("cohens_d"),
        labels.effect_label_short(d).alias("effect"),
        "statistic",
        "df",
    )


def ab_advice(df: DataFrame, group: str = "group", metric: str = "metric", alpha: float = 0.05) -> DataFrame:
    """Advice by significance and by effect size."""
    row = ab_effect(df, group, metric)
    p = probability.t_p_value(F.col("statistic"), F.col("df"))
    by_size = F.when(F.col("effect") == "large", "apply_now").when(F.col("effect") == "medium", "apply_after_review").otherwise("weigh_impact")
    return row.withColumn("p_value", p).select(
        F.explode(
            F.array(F.when(F.col("p_value") < alpha, F.lit("choose_winner")).otherwise(F.lit("collect_more_data")), by_size)
        ).alias("advice")
    )


# --- registry ---------------------------------------------------------------------------


@dataclass
class Template:
    name: str
    description: str
    required: Sequence[str]
    run: Callable[[DataFrame], dict[str, DataFrame]]
    optional: Sequence[str] = field(default_factory=tuple)

    def check(self, df: DataFrame) -> list[str]:
        """Required columns the table lacks."""
        return [c for c in self.required if c not in df.columns]


def _customer(df: DataFrame) -> dict[str, DataFrame]:
    scored, segmented = rfm(df), segments(df)
    return {
        "rfm": scored,
        "rfm_stats": descriptive(scored, ["recency", "frequency", "monetary"]),
        "rfm_distribution": rfm_distribution(scored),
        "segments": segmented,
        "segment_stats": segment_stats(segmented),
        "by_month": purchase_patterns(df, "month"),
        "by_weekday": purchase_patterns(df, "weekday"),
        "by_customer": purchase_patterns(df, "customer"),
        "advice": customer_advice(scored, segmented),
        "chart_rfm": charts.histogram(scored, "rfm_score", 13),
        "chart_segments": charts.pie(segmented, "segment"),
        "chart_months": charts.line(purchase_patterns(df, "month"), "month", ["total"]),
    }


def _sales(df: DataFrame) -> dict[str, DataFrame]:
    out = {
        "monthly": monthly_sales(df),
        "trend": sales_trend(df),
        "seasonality": sales_seasonality(df),
        "advice": sales_advice(df),
        "chart_monthly": charts.line(monthly_sales(df), "month", ["total"]),
    }
    if "product_category" in df.columns:
        out["categories"] = sales_by_category(df)
        out["chart_categories"] = charts.bar(df, "product_category", "sales_amount")
    return out


def _ab(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "basic": ab_basic(df),
        "effect": ab_effect(df),
        "advice": ab_advice(df),
        "chart_histogram": charts.histogram(df, "metric", 30, hue="group"),
        "chart_box": charts.box(df, "metric", ["group"]),
    }


TEMPLATES: dict[str, Template] = {
    t.name: t
    for t in [
        Template("customer_analysis", "RFM, segments and purchase patterns", ("customer_id", "purchase_date", "purchase_amount"), _customer),
        Template("sales_analysis", "trend, seasonality and categories", ("sales_date", "sales_amount"), _sales, ("product_category",)),
        Template("ab_test_analysis", "two groups compared on one metric", ("group", "metric"), _ab),
    ]
}


def register(template: Template) -> None:
    TEMPLATES[template.name] = template


def names() -> Mapping[str, str]:
    return {t.name: t.description for t in TEMPLATES.values()}


def execute(name: str, df: DataFrame) -> dict[str, DataFrame]:
    """All frames of a template, unevaluated."""
    if name not in TEMPLATES:
        raise KeyError(name)
    require(df, TEMPLATES[name].required)
    return TEMPLATES[name].run(df)
