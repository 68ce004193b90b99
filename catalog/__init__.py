"""Queries over the given tables, one or more per operator, with the SQL they must equal."""

from catalog import chartdata, corpus, scoring

MODULES = (chartdata, corpus, scoring)


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
