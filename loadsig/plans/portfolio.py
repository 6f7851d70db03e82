"""The complete characterisation of a portfolio of buildings.

Each result that several later steps read is written once to the shared
folder, which also keeps the run restartable after lost executors.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadsig.functions.calendar import add_calendar
from loadsig.functions.signature import PARAMETERS, changepoint_eval
from loadsig.operators import classify, daytypes, evaluate, outliers, profiles
from loadsig.operators.fit import fit_changepoint
from loadsig.operators.outliers import Z95, attach_params
from loadsig.operators.repair import repair
from loadsig.session import materialise
from loadsig.sources.readings import require_unique_hours

HOUR_KEY = ["building_id", "DATE_hour_week"]


@dataclass
class Characterisation:
    """Tables a characterisation leaves behind."""

    params_initial: DataFrame
    scored: DataFrame
    repaired: DataFrame
    params_tow: DataFrame
    readings: DataFrame
    assignments: DataFrame
    chosen_k: DataFrame
    tree: DataFrame
    days: DataFrame
    report: DataFrame
    params_cluster: DataFrame
    params_cluster_pred: DataFrame
    comparison: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    outlier_months: DataFrame
    monthly: DataFrame
    profiles: DataFrame
    runs: DataFrame

    def views(self) -> dict[str, DataFrame]:
        """The tables behind the plots: residual histogram, profiles of the day
        types, rules of the tree, and for the coldest, hottest and temperate
        months and weeks the chosen period, the load by hour of the week and the
        box statistics."""
        kinds = ("coldest", "hottest", "temperate")

        def of_kinds(make) -> DataFrame:
            parts = [make(kind).withColumn("kind", F.lit(kind)) for kind in kinds]
            return parts[0].unionByName(parts[1]).unionByName(parts[2])

        out = {
            "residual_histogram": outliers.residual_histogram(self.scored),
            "cluster_profiles": profiles.cluster_profiles(self.profiles.join(self.assignments, ["building_id", profiles.DAY])),
            "tree_rules": classify.tree_table(self.tree),
        }
        for unit, by in (("month", "DATE_day_month"), ("week", "DATE_day_week")):
            out[f"climate_{unit}"] = of_kinds(lambda kind, unit=unit: evaluate.climate_period(self.comparison, unit, kind))
            out[f"hour_of_week_{unit}"] = of_kinds(
                lambda kind, unit=unit: evaluate.hour_of_week_profile(self.comparison, kind, unit))
            out[f"boxes_{unit}"] = of_kinds(
                lambda kind, unit=unit, by=by: evaluate.box_stats(self.comparison, unit, kind, by))
        return out

    def write(self, folder: str) -> None:
        """Write every table and view as Parquet under ``folder``, by its name. A
        table that is there already makes it fail."""
        tables = {table.name: getattr(self, table.name) for table in fields(self)} | self.views()
        for name, table in tables.items():
            table.write.parquet(f"{folder.rstrip('/')}/{name}")


def _fitted(params: DataFrame) -> DataFrame:
    keys = [c for c in params.columns if c not in (*PARAMETERS, "loss", "bound", "n_rows", "status")]
    return params.select(*keys, *PARAMETERS)


def characterise(readings: DataFrame, k_max: int = daytypes.K_MAX, n_init: int = daytypes.N_INIT,
                 attribution: str = "predicted", effort: int = 0) -> Characterisation:
    """Fit, clean, refit, find day types, learn to predict them, fit day-type
    models and compare all models. ``effort`` is that of the fits.

    ``attribution="predicted"`` scores the third model with predicted day
    types, ``"actual"`` with the actual ones. Rows without a time are kept as far
    as the repair (``scored``, ``repaired``); no model is fitted to them. ``runs``
    tells of every building and k whether k-means had converged.
    """
    base = materialise(add_calendar(readings), "readings")
    require_unique_hours(base)
    timed = F.col("DATE").isNotNull()

    # hour-of-week models and outliers over the building
    first = materialise(fit_changepoint(base.filter(timed), HOUR_KEY, effort=effort), "params-initial")
    scored = outliers.flag_outliers(outliers.score_readings(base, _fitted(first)), "global").drop(*PARAMETERS)
    scored = materialise(scored, "scored")

    # repair, then fit again on the repaired power
    repaired = repair(scored.withColumn("IS_Outlier", F.col("is_outlier_global")))
    repaired = materialise(repaired.drop("Power_fitted", "Power_residuals"), "repaired")
    current = evaluate.use_corrected(repaired).filter(timed)
    tow = materialise(fit_changepoint(current, HOUR_KEY, effort=effort), "params-tow")
    final = changepoint_eval(attach_params(current, _fitted(tow)), "Power_fitted_TOW").drop(*PARAMETERS)
    final = outliers.flag_outliers(final, "group", HOUR_KEY, Z95)
    final = materialise(final.drop("Power_residuals"), "final")

    # day types and their prediction
    points = profiles.normalise_vectors(profiles.day_vectors(profiles.day_matrix(final)))
    points = materialise(points, "profiles")
    assignments, chosen, runs = daytypes.day_types(points, k_max, n_init)
    assignments = materialise(assignments, "assignments")
    days = classify.labelled_days(classify.daily_features(final), assignments)
    days = materialise(classify.stratified_split(days), "days")
    tree = classify.fit_tree(days.filter("NOT is_test"))
    days = materialise(classify.predict_day_type(days, tree), "days-predicted")
    cells = materialise(classify.confusion_cells(days.filter("is_test")), "confusion")
    report = classify.classification_report(cells)

    # day-type models on rows with every value known
    complete = ["Temperature", "Solar_Irradiation", "Power_original", "Power"]
    typed = evaluate.attach_day_types(final, days, ["cluster", "cluster_PRED"]).na.drop("any", subset=complete)
    typed = typed.withColumns({"ClusterHour": evaluate.cluster_hour("cluster"),
                               "ClusterHour_PRED": evaluate.cluster_hour("cluster_PRED")})
    typed = materialise(typed, "typed")
    by_type = materialise(fit_changepoint(typed, ["building_id", "ClusterHour"], effort=effort), "params-cluster")
    by_pred = materialise(fit_changepoint(typed, ["building_id", "ClusterHour_PRED"], effort=effort), "params-cluster-pred")

    # comparison on trusted rows
    third = {"predicted": "cluster_PRED", "actual": "cluster"}[attribution]
    rows = evaluate.trusted_rows(typed)
    rows = evaluate.add_cluster_fit(rows, _fitted(by_type), "cluster", "ClusterHour", "Power_fitted_ClustH")
    rows = evaluate.add_cluster_fit(rows, _fitted(by_pred), third, "ClusterHour_PRED", "Power_fitted_ClustH_PRED")
    comparison = materialise(evaluate.cumulated_residuals(evaluate.drop_working(rows)), "comparison")
    return Characterisation(
        first, scored, repaired, tow, final, assignments, chosen, tree, days, report,
        by_type, by_pred, comparison, evaluate.model_metrics(comparison),
        classify.confusion_long(cells), outliers.outliers_by_month(scored.filter(timed)), evaluate.monthly_load(comparison),
        points, runs,
    )
