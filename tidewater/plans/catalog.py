"""Imports every plan module so that its queries are registered."""

from tidewater.plans import base_views, cell_plans, episode_plans, extra_plans, fair_value_plans, feed_plans, flow_plans, grid_plans, group_plans, momentum_plans, outcome_plans, panel_plans, regime_plans, stats_plans, study_plans, valuation_plans  # noqa: F401
from tidewater.plans.registry import QUERIES, oracle_sql

__all__ = ["QUERIES", "oracle_sql"]
