"""Industry-relative features; per (date, industry) statistics join back to the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgrid.core import attach
from quantgrid.functions.scalar import safe_div
from quantgrid.operators import rolling as R
from quantgrid.operators.order_stats import group_medians
from quantgrid.operators.xsection import INDUSTRY_CODES, industry_agg

KEYS = ["date_idx", "industry"]


def industry_relative(panel: DataFrame, pe: str = "pe", pb: str = "pb", roe: str = "roe", debt: str = "debt_ratio",
                      revenue_growth: str = "revenue_yoy", cash_flow: str = "ocf") -> DataFrame:
    """pe gap to the median, pb over the median - 1, descending roe rank, relative debt gap,
    revenue-growth z-score and share of the industry's cash flow.

    All moments come from one aggregate, both medians from one histogram pass.
    """
    known = panel.where(F.col("industry").between(0, INDUSTRY_CODES - 1))
    moments = known.groupBy(*KEYS).agg(
        F.avg(debt).alias("_debt"), F.avg(revenue_growth).alias("_rev"), F.stddev_samp(revenue_growth).alias("_rev_sd"),
        F.coalesce(F.sum(cash_flow), F.lit(0.0)).alias("_ocf"))
    j = attach(attach(panel, moments, KEYS), group_medians(known, KEYS, [pe, pb]), KEYS)
    j = industry_agg(j, roe, "rank", "roe_rank")
    return j.withColumns({
        "pe_gap": F.col(pe) - F.col(f"{pe}_med"),
        "pb_gap": safe_div(pb, f"{pb}_med") - 1,
        "debt_gap": safe_div(F.abs(F.col(debt) - F.col("_debt")), "_debt"),
        "revenue_z": safe_div(F.col(revenue_growth) - F.col("_rev"), "_rev_sd"),
        "cash_share": safe_div(cash_flow, "_ocf"),
    }).drop("_debt", "_rev", "_rev_sd", "_ocf", f"{pe}_med", f"{pb}_med")


def industry_corr(panel: DataFrame, r: str = "r", window: int = 20, out: str = "industry_corr") -> DataFrame:
    """Rolling correlation of a tick with the mean return of its industry."""
    j = industry_agg(panel, r, "mean", "_ind")
    return j.withColumn(out, R.rolling_corr(r, "_ind", window)).drop("_ind")
