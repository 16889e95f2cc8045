"""Native column expressions (keys, parsing, statistics, composite indices)."""

from covary.functions.index import weighted_index
from covary.functions.keys import (
    distinct_names,
    month_from_position,
    month_start,
    month_text,
    months_since,
    parse_timestamp,
    period_number,
    safe_int,
    sanitize_columns,
    sanitize_name,
    sanitized_names,
    split_date_key,
    split_part,
    timestamp_text,
    zero_pad,
)
from covary.functions.stats import (
    MACHINE_EPSILON,
    safe_div,
    safe_sqrt,
    t_cdf,
    t_central_mass,
    t_two_sided_p,
)

__all__ = [
    "MACHINE_EPSILON",
    "distinct_names",
    "month_from_position",
    "month_start",
    "month_text",
    "months_since",
    "parse_timestamp",
    "period_number",
    "safe_div",
    "safe_int",
    "safe_sqrt",
    "sanitize_columns",
    "sanitize_name",
    "sanitized_names",
    "split_date_key",
    "split_part",
    "t_cdf",
    "t_central_mass",
    "t_two_sided_p",
    "timestamp_text",
    "weighted_index",
    "zero_pad",
]
