"""All registered queries of the normalization engine and their SQL. The modules of this folder add theirs to the same tables; only here are they all loaded."""

from __future__ import annotations

from lexweave.plans import generation, policies, queries as _base  # noqa: F401


def queries() -> dict:
    return dict(_base._Q)


def oracle_sql() -> dict[str, str]:
    return dict(_base._SQL)
