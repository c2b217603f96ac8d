"""From a history to remediation plans, for every drift event at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.functions.runtime import cut_lineage
from meander.operators import attribution
from meander.operators import changes as ch
from meander.operators import counterfactual as cf
from meander.operators import remediation as rm
from meander.operators.series import mean_shift_events, metric_series


class Remediation:
    """The tables of one remediation run; each is built when first asked for.

    Series, events, changes (without details), best factors and results are stored once, as several later tables
    build on them.
    """

    def __init__(self, history: DataFrame, by: list[str], metric_name: str, window: int, threshold: float, top_k: int):
        self.history, self.by, self.metric_name = history, by, metric_name
        self.window, self.threshold, self.top_k = window, threshold, top_k

    @cached_property
    def series(self) -> DataFrame:
        # five passes follow; the series is a narrow slice of the records
        return cut_lineage(metric_series(self.history, self.metric_name, self.by))

    @cached_property
    def events(self) -> DataFrame:
        found = mean_shift_events(self.series, self.by, ["ts", "seq", "pos"], self.window, self.threshold)
        return cut_lineage(found.withColumn("metric_name", F.lit(self.metric_name)))

    @cached_property
    def changes(self) -> DataFrame:
        return ch.change_events(self.history, self.by)

    @cached_property
    def brief_changes(self) -> DataFrame:
        """The changes without what they hold in detail, for the steps that have no use for it."""
        return cut_lineage(self.changes.select(*self.by, "change_id", "run_id", "change_type", "ts", "seq"))

    @cached_property
    def factors(self) -> DataFrame:
        """Every change scored for every event of its stream (the full report, not stored)."""
        return ch.attribution_scores(ch.event_change_features(self.events, self.brief_changes, self.by), self.by)

    @cached_property
    def _summary(self) -> tuple[DataFrame, DataFrame]:
        return attribution.attribution_summary(self.events, self.brief_changes, self.by, self.top_k + 1)

    @cached_property
    def best_factors(self) -> DataFrame:
        """The ``top_k`` best factors of each event and the one after them."""
        return self._summary[0]

    @cached_property
    def attributions(self) -> DataFrame:
        return self._summary[1]

    @cached_property
    def estimates(self) -> DataFrame:
        return cf.estimates(self.events, self.series, self.by)

    @cached_property
    def scenarios(self) -> DataFrame:
        return cf.scenarios(self.best_factors, self.by, self.top_k)

    @cached_property
    def counterfactuals(self) -> DataFrame:
        return cut_lineage(cf.counterfactuals(self.events, self.scenarios, self.estimates, self.by))

    @cached_property
    def actions(self) -> DataFrame:
        return rm.remediation_actions(ch.rank_factors(self.factors, self.by), self.by)

    @cached_property
    def recommendations(self) -> DataFrame:
        return rm.recommendation_rank(rm.action_impact(self.actions, self.counterfactuals, self.by), self.by)

    @cached_property
    def plans(self) -> DataFrame:
        """Actions past the best ``top_k`` have no estimated effect and keep factor order, so
        the best recommendation is among the ``top_k + 1`` best factors."""
        actions = rm.remediation_actions(self.best_factors, self.by)
        recs = rm.recommendation_rank(rm.action_impact(actions, self.counterfactuals, self.by), self.by)
        return rm.optimization_plan(self.events, recs, self.attributions, self.by)


def remediate(
    history: DataFrame, by: list[str], metric_name: str = "js_divergence",
    window: int = 3, threshold: float = 0.15, top_k: int = 3,
) -> Remediation:
    """Detect mean shifts, attribute them to changes, estimate and rank remedies."""
    return Remediation(history, by, metric_name, window, threshold, top_k)
