from chartmeter.operators.bins import density_1d, grid_2d, histogram
from chartmeter.operators.boxes import box_stats
from chartmeter.operators.groups import agg_by, count_by, count_where, rate_by, share, trend
from chartmeter.operators.ranking import (
    argmax_per_group,
    topk_filter,
    topk_groups,
    topk_rows,
    topk_show,
)
from chartmeter.operators.rows import (
    category_values,
    compare_to_row,
    density_points,
    pairs,
    row_filter,
    unpivot_measures,
)
from chartmeter.operators.running import cumulative
from chartmeter.operators.surfaces import hex_bins, kernel_density, kernel_density_2d

__all__ = [
    "agg_by",
    "argmax_per_group",
    "box_stats",
    "category_values",
    "compare_to_row",
    "count_by",
    "count_where",
    "cumulative",
    "density_1d",
    "density_points",
    "grid_2d",
    "hex_bins",
    "histogram",
    "kernel_density",
    "kernel_density_2d",
    "pairs",
    "rate_by",
    "row_filter",
    "share",
    "topk_filter",
    "topk_groups",
    "topk_rows",
    "topk_show",
    "trend",
    "unpivot_measures",
]
