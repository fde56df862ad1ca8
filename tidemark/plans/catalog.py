"""Registered queries over the driver's tables and the SQL that gives the same rows.

A query ``name`` of a plan module has its SQL in the constant ``NAME`` of the
same module, where SQL can express it.
"""

from __future__ import annotations

import inspect

from tidemark.plans import access, cluster, files, placement, scalars, series, state, storage, streams

FLAGSHIP = "gc_sweep"
QUERIES: dict = {}
ORACLES: dict = {}
for _module in (storage, placement, state, series, scalars, access, cluster, files, streams):
    for _name, _f in list(vars(_module).items()):
        if inspect.isfunction(_f) and _f.__module__ == _module.__name__ and not _name.startswith("_"):
            QUERIES[_name] = _f
            if _name.upper() in vars(_module):
                ORACLES[_name] = vars(_module)[_name.upper()].strip()
