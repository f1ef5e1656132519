"""Registered queries over the given tables, grouped by topic."""

import importlib

TOPICS = ("rolling", "xsection", "evaluate", "pit", "factor", "sample", "source")


def load():
    for topic in TOPICS:
        importlib.import_module(f"quantgrid.plans.{topic}_queries")
    return importlib.import_module("quantgrid.plans.registry")
