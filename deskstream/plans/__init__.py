"""Registered queries: one per operator, each over whole driver tables, with its oracle."""

from deskstream.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]


def load() -> None:
    """Import every family so that its queries register."""
    from deskstream.plans import (  # noqa: F401
        evaluation,
        expressions,
        ingest,
        lifecycle,
        metrics,
        modelling,
        relational,
        retrieval,
        similarity,
        streams,
    )
