"""DataFrame -> DataFrame operators."""

from covary.operators.counts import (
    category_counts,
    category_map,
    combination_counts,
    dimension_counts,
    distinct_sorted,
    ordered_series,
    period_counts,
    pivot_counts,
    summary_stats,
    unpivot_dimensions,
    wide,
)
from covary.operators.enrich import (
    code_ranges,
    haversine_km,
    in_open_range,
    nearest_area,
    range_join,
    with_indicator,
)
from covary.operators.position import with_line_number, with_position
from covary.operators.ranking import keep_top, rank_within, top_k
from covary.operators.series import (
    chronological_split,
    lag_features,
    lag_forecast,
    min_max_scale,
)
from covary.operators.sized import guarded_join, is_small
from covary.operators.stats import (
    category_screen,
    correlation_by,
    correlation_expr,
    directional_screen,
    elastic_net_1d,
    moments,
    score_linear,
    slope_test,
    zero_filled_moments,
)

__all__ = [
    "category_counts", "category_map", "category_screen", "chronological_split",
    "code_ranges", "combination_counts", "correlation_by", "correlation_expr",
    "dimension_counts", "directional_screen", "distinct_sorted", "elastic_net_1d", "guarded_join", "haversine_km",
    "in_open_range", "is_small", "keep_top", "lag_features", "lag_forecast", "min_max_scale",
    "moments", "nearest_area", "ordered_series", "period_counts", "pivot_counts",
    "range_join", "rank_within", "score_linear", "slope_test", "summary_stats", "top_k",
    "unpivot_dimensions", "wide", "with_indicator", "with_line_number", "with_position", "zero_filled_moments",
]
