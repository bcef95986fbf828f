"""Suspicious patterns, rule-based recommendations and the full report.

The merchant profile feeds three of these; it is computed once per report
(the source computed it four times per report).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.aggs import ensure
from . import aggregates as A
from . import filters as Fl


def suspicious_summary(df: DataFrame, *, id_col: str = "order_id", left: str = "gsm_amount",
                       right: str = "merchant_amount", ratio: float = S.HIGH_DISCREPANCY_RATIO,
                       rate_threshold: float = S.UNUSUAL_MERCHANT_RATE,
                       patterns: DataFrame | None = None) -> DataFrame:
    """A19 in one tagged long table: ``(pattern, item, metric)``.

    * ``duplicate_orders``: item = order id, metric = copies
    * ``high_amount_discrepancy``: item = order id, metric = percent difference
    * ``unusual_merchants``: item = merchant, metric = discrepancy rate

    Every matching record is kept (no display cap, D12).
    """
    patterns = patterns if patterns is not None else A.merchant_patterns(df, sort=False)
    dup = A.duplicate_orders(df, id_col=id_col).select(
        F.lit("duplicate_orders").alias("pattern"), F.col("order_id").alias("item"),
        F.col("count").cast("double").alias("metric"))
    high = Fl.high_amount_discrepancy(df, left=left, right=right, ratio=ratio).select(
        F.lit("high_amount_discrepancy").alias("pattern"), F.col("order_id").alias("item"),
        F.col("diff_percentage").alias("metric"))
    unusual = A.unusual_merchants(patterns, rate_threshold=rate_threshold).select(
        F.lit("unusual_merchants").alias("pattern"), F.col("merchant").alias("item"),
        F.col("discrepancy_rate").alias("metric"))
    return dup.unionByName(high).unionByName(unusual)


def recommendation_metrics(df: DataFrame, *, status_col: str = "reconcile_status", id_col: str = "order_id",
                           left: str = "gsm_amount", right: str = "merchant_amount",
                           ratio: float = S.HIGH_DISCREPANCY_RATIO,
                           review_rate: float = S.REVIEW_MERCHANT_RATE,
                           patterns: DataFrame | None = None) -> DataFrame:
    """The one-row metric frame behind the rules.

    The status counts and the high-discrepancy count are one global aggregate
    over the base; the merchant and duplicate counts need their own grouping and
    are scalar subqueries (each a distributed aggregate yielding one value), so
    nothing is cross-joined and nothing is collected.
    """
    df = ensure(df, status_col, id_col, left, right)
    patterns = patterns if patterns is not None else A.merchant_patterns(df, sort=False)
    st = F.col(status_col)
    base = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(st == S.STATUS_MATCH).alias("match_count"),
        F.count_if(F.coalesce(st.contains(S.STATUS_ONLY_M), F.lit(False))).alias("only_m_count"),
        F.count_if(F.coalesce(st.contains(S.STATUS_ONLY_EXTERNAL), F.lit(False))).alias("only_external_count"),
        F.count_if(Fl.high_discrepancy(left, right, ratio)).alias("high_discrepancy_rows"))
    review = patterns.where(F.col("discrepancy_rate") > F.lit(float(review_rate))).select(F.count(F.lit(1)))
    dups = A.duplicate_orders(df, id_col=id_col).select(F.count(F.lit(1)))
    return base.select(
        "*",
        F.coalesce(F.try_divide(F.col("match_count").cast("double") * F.lit(100.0),
                                F.col("total_records").cast("double")), F.lit(0.0)).alias("match_rate"),
        review.scalar().alias("review_merchants"),
        dups.scalar().alias("duplicate_ids"))


def recommendations(df: DataFrame, *, low_match_rate: float = S.LOW_MATCH_RATE,
                    one_sided_share: float = S.ONE_SIDED_SHARE, **kw) -> DataFrame:
    """The rules that fire, as rows ``(rule, value, threshold)``.

    Rules: match rate < 80 %; insurer-only rows > 5 % of rows; platform-only rows
    > 5 %; merchants with discrepancy rate > 15 % exist; duplicate ids exist;
    high amount discrepancies exist.  When none fires the single rule ``stable``
    is returned.  The status rules only apply when the table has rows.
    """
    m = recommendation_metrics(df, **kw)
    total = F.col("total_records").cast("double")
    has_rows = F.col("total_records") > 0
    share = F.lit(float(one_sided_share))
    rules = [
        ("low_match_rate", F.col("match_rate"), F.lit(float(low_match_rate)),
         has_rows & (F.col("match_rate") < F.lit(float(low_match_rate)))),
        ("insurer_only_share", F.col("only_m_count").cast("double"), total * share,
         has_rows & (F.col("only_m_count") > total * share)),
        ("platform_only_share", F.col("only_external_count").cast("double"), total * share,
         has_rows & (F.col("only_external_count") > total * share)),
        ("merchants_to_review", F.col("review_merchants").cast("double"), F.lit(0.0),
         F.col("review_merchants") > 0),
        ("duplicate_order_ids", F.col("duplicate_ids").cast("double"), F.lit(0.0), F.col("duplicate_ids") > 0),
        ("high_amount_discrepancy", F.col("high_discrepancy_rows").cast("double"), F.lit(0.0),
         F.col("high_discrepancy_rows") > 0),
    ]
    fired_any = F.lit(False)
    for _, _, _, fired in rules:
        fired_any = fired_any | fired
    structs = [F.struct(F.lit(name).alias("rule"), v.alias("value"), t.alias("threshold"), f.alias("fired"))
               for name, v, t, f in rules]
    structs.append(F.struct(F.lit("stable").alias("rule"), F.lit(None).cast("double").alias("value"),
                            F.lit(None).cast("double").alias("threshold"), (~fired_any).alias("fired")))
    return (m.select(F.explode(F.array(*structs)).alias("r"))
            .where(F.col("r.fired")).select("r.rule", "r.value", "r.threshold"))


def reconciliation_report(df: DataFrame, *, cache: bool = False, **kw) -> dict[str, DataFrame]:
    """Every part of the report as a DataFrame over one shared base.

    The merchant profile is built once and shared.  Over the silver Parquet
    table no cache is needed: each part reads only its columns.  ``cache=True``
    persists the base (memory and disk) when it is a costly lineage such as a
    raw CSV load; the caller then unpersists ``report["base"]``.
    """
    base = df.persist() if cache else df
    patterns = A.merchant_patterns(base, sort=False)
    hourly = A.hourly_patterns(base, sort=False)
    return {
        "base": base,
        "summary": A.reconcile_status_summary(base),
        "insurer_only": Fl.one_sided(base, "m"),
        "platform_only": Fl.one_sided(base, "external"),
        "amount_mismatch": Fl.amount_mismatch(base),
        "merchant_analysis": patterns,
        "hourly": hourly,
        "peak_hour": A.peak_hour(hourly),
        "suspicious": suspicious_summary(base, patterns=patterns),
        "recommendations": recommendations(base, patterns=patterns, **kw),
    }
