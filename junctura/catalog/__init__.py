"""Registered queries: each a Spark function over the given tables and, where SQL can say it, its twin."""

from __future__ import annotations

from junctura.catalog import clusters, files, learning, reads, sampling, vectors

MODULES = (reads, sampling, vectors, clusters, learning, files)


def all_queries() -> dict:
    out = {}
    for module in MODULES:
        for name, (run, _) in module.QUERIES.items():
            if name in out:
                raise KeyError(f"query {name!r} is registered twice")
            out[name] = run
    return out


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
