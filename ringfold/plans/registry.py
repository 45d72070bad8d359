"""All registered queries: name -> (Spark callable, checking SQL or None)."""

from __future__ import annotations

from . import checks, cohort, curves, fits, images, learning, tables

REGISTRY = {
    **images.QUERIES,
    **checks.QUERIES,
    **tables.QUERIES,
    **curves.QUERIES,
    **cohort.QUERIES,
    **fits.QUERIES,
    **learning.QUERIES,
}
