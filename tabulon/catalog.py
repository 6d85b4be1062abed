"""All queries of the library, apart from those of the corpus operators."""

from __future__ import annotations

from .queries import learning, lists, numbers, pages, sequences, spatial, words  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
