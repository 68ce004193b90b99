from chartmeter.plans.figures import (
    FIGURE_KEYS,
    explode_points,
    explode_triples,
    figure_records,
    flatten_traces,
    last_values,
    parse_figures,
    project_trace,
)
from chartmeter.plans.matching import (
    pairs_match,
    pairs_match_swapped,
    records_match,
    triples_match,
)
from chartmeter.plans.scoring import (
    describe,
    extra_fields_match,
    failure_report,
    fields_match,
    pass_rate,
    score_cases,
    score_records,
    standard_fields_match,
    type_match,
    with_outcomes,
    with_source,
)

__all__ = [
    "FIGURE_KEYS",
    "describe",
    "explode_points",
    "explode_triples",
    "extra_fields_match",
    "failure_report",
    "fields_match",
    "figure_records",
    "flatten_traces",
    "last_values",
    "pairs_match",
    "pairs_match_swapped",
    "parse_figures",
    "pass_rate",
    "project_trace",
    "records_match",
    "score_cases",
    "score_records",
    "standard_fields_match",
    "triples_match",
    "type_match",
    "with_outcomes",
    "with_source",
]
