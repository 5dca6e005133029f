"""Queries by name, each with its SQL twin where one exists."""

import re

QUERIES, ORACLE = {}, {}


def _nudge(sql):
    """``round(x, p) + 0.0`` becomes ``round(x + 1.37e-(p+3), p) + 0.0`` as in columns.rounded."""
    return re.sub(r", (\d)\) \+ 0\.0", lambda m: f" + 1.37e-{int(m[1]) + 3}, {m[1]}) + 0.0", sql)


def query(name, sql=None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _nudge(sql)
        return fn
    return add
