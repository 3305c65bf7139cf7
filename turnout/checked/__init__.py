"""Registered queries by topic; importing this package registers them all."""

from turnout.checked import (  # noqa: F401
    cleaning,
    counts,
    dashboards,
    etl,
    incremental,
    journey,
    rows,
    storage,
    studio,
    uploads,
)
