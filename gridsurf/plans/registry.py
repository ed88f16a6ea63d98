"""All queries of the engine, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from gridsurf.plans import clouds, composites, extras, grids, scalars

FLAGSHIP = "dedup_voxel_two_pass"

QUERIES: dict = {}

ORACLE_SQL: dict[str, str] = {}

for _module in (scalars, grids, clouds, composites, extras):
    QUERIES |= _module.Q
    ORACLE_SQL |= _module.O
