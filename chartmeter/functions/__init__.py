from chartmeter.functions.keys import bin_index, case_id, date_part, number_bands
from chartmeter.functions.values import (
    comparison_form,
    round_cents,
    tag_column,
    tag_variant,
    values_match,
)

__all__ = [
    "bin_index",
    "case_id",
    "comparison_form",
    "date_part",
    "number_bands",
    "round_cents",
    "tag_column",
    "tag_variant",
    "values_match",
]
