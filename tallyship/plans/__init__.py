"""Queries that apply the library's operators to the test tables."""

from tallyship.plans import decisions, joins, scans, streams, tables, windows
from tallyship.plans import upkeep  # made of the others' queries
from tallyship.plans.registry import ORACLES, QUERIES

GROUPS = (windows, scans, decisions, joins, tables, streams, upkeep)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
