"""Whole analyses and the registered queries."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("log_queries", "longop_queries", "tablet_queries", "flag_queries", "report_queries", "raw_queries", "stream_queries")


def _registry():
    for name in _MODULES:
        import_module(f"bundlelens.plans.{name}")
    return import_module("bundlelens.plans.registry")


def all_queries():
    return dict(_registry().QUERIES)


def all_oracles():
    return dict(_registry().ORACLES)
