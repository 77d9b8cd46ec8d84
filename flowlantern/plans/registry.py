"""Imports every plan module, so that all queries are registered."""

from flowlantern.plans import alerts, features, flows, logs, models, packets, rules, streams  # noqa: F401
from flowlantern.plans.base import ORACLES, QUERIES  # noqa: F401
