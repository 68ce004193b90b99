from chartmeter.sources.corpus import (
    CASE_SCHEMA,
    build_cases,
    corpus_summary,
    filter_cases,
    read_cases,
    read_goldens,
    write_cases,
    write_goldens,
)
from chartmeter.sources.tables import count_misfits, read_source

__all__ = [
    "CASE_SCHEMA",
    "build_cases",
    "corpus_summary",
    "count_misfits",
    "filter_cases",
    "read_cases",
    "read_goldens",
    "read_source",
    "write_cases",
    "write_goldens",
]
