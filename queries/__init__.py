"""The registered queries: every operator on the given tables, each with the SQL that checks it."""

from queries.base import REGISTRY
from queries import cache, changes, corpus, findings, reports, reviews, scoring, streams, usage  # noqa: F401


def all_queries():
    return {name: run for name, (run, _) in REGISTRY.items()}


def all_oracles():
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
