"""All registered queries and oracles of the transit library."""

from fareflow.plans import demand, models, routing, taps, times  # noqa: F401
from fareflow.plans.registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
