"""Everything that can be run, in one place."""

from granary.plans import dashboard, decisions, feeds, forecasts, inventory, listing, streams  # noqa: F401
from granary.plans.registry import oracles, runnable  # noqa: F401
