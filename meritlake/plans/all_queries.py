"""Loads every query module and hands out the registry."""

from meritlake.plans import (  # noqa: F401
    catalog_answers, catalog_relational, catalog_rules, catalog_text)
from meritlake.plans.catalog import oracles, queries  # noqa: F401
