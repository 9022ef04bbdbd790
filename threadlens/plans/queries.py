"""All registered queries."""

from threadlens.plans import find, mail, tables, tagging  # noqa: F401
from threadlens.plans.registry import ORACLES, QUERIES  # noqa: F401
