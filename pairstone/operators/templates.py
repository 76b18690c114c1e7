"""Assignment of pages to printed forms: a least-squares fit of each prototype, from sums alone.

One scale and two offsets carry a prototype's label places to the page's. All that the fit needs are
sums over matched labels, so pages and prototypes meet in one join and one pre-aggregated pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LABELS, MOST_RESIDUAL, MARGIN = 3, 80.0, 1.5


def fits(labels: DataFrame, prototypes: DataFrame) -> DataFrame:
    """page, family, n, scale, residual for labels(page, field, x, y) and prototypes(family, field, px, py).

    Pages that share fewer than LEAST_LABELS labels with a family, or only coinciding ones, don't fit it.
    """
    met = labels.join(F.broadcast(prototypes), "field")  # a registry of forms: a few rows for each
    s = {k: F.sum(e).cast("double") for k, e in {"x": F.col("x"), "y": F.col("y"), "px": F.col("px"), "py": F.col("py"), "pp": F.col("px") * F.col("px") + F.col("py") * F.col("py"), "xp": F.col("x") * F.col("px") + F.col("y") * F.col("py"), "xx": F.col("x") * F.col("x") + F.col("y") * F.col("y")}.items()}
    sums = met.groupBy("page", "family").agg(F.count("*").alias("n"), *[v.alias(f"s_{k}") for k, v in s.items()]).where(F.col("n") >= LEAST_LABELS)
    n = F.col("n")
    spread = F.col("s_pp") - (F.col("s_px") * F.col("s_px") + F.col("s_py") * F.col("s_py")) / n
    along = F.col("s_xp") - (F.col("s_x") * F.col("s_px") + F.col("s_y") * F.col("s_py")) / n
    total = F.col("s_xx") - (F.col("s_x") * F.col("s_x") + F.col("s_y") * F.col("s_y")) / n
    fitted = sums.where(spread > 0).select("page", "family", "n", (along / spread).alias("scale"), F.sqrt(F.greatest(F.lit(0.0), total - along * along / spread) / n).alias("residual"))
    return fitted.where("scale > 0")


def assigned(found: DataFrame) -> DataFrame:
    """page, family, residual, runner_up: the best form, if it fits well and the next best is clearly worse."""
    ranked = found.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("residual", "family"))).alias("r"))  # a row for each form
    best, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    clear = second.isNull() | (second["residual"] >= MARGIN * best["residual"])
    return ranked.where((best["residual"] <= MOST_RESIDUAL) & clear).select("page", best["family"].alias("family"), F.round(best["residual"], 4).alias("residual"), F.round(second["residual"], 4).alias("runner_up"))
