"""All registered queries and their oracle SQL, merged from the per-area modules."""

from __future__ import annotations

import importlib

# Per-area query modules; each exposes QUERIES (name -> fn(spark, sf_dir)) and
# ORACLE (name -> DuckDB SQL). A query without an ORACLE entry is checked by
# invariants in tests/ and by rows only in the driver.
_MODULES = [
    "tessera.plans.cashflow_queries",
    "tessera.plans.profile_queries",
    "tessera.plans.lag_queries",
    "tessera.plans.sampling_queries",
    "tessera.plans.model_queries",
    "tessera.plans.forecast_queries",
    "tessera.plans.image_queries",
    "tessera.plans.catalog_queries",
]


def _load():
    queries, oracle = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        for k in mod.QUERIES:
            if k in queries:
                raise ValueError(f"duplicate query name {k}")
        queries.update(mod.QUERIES)
        oracle.update(getattr(mod, "ORACLE", {}))
    unknown = set(oracle) - set(queries)
    if unknown:
        raise ValueError(f"oracle without query: {sorted(unknown)}")
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
