"""Queries and their SQL by name."""

from . import detecting, extra, flows, serving, varied

QUERIES: dict = {**detecting.QUERIES, **serving.QUERIES, **extra.QUERIES, **flows.QUERIES, **varied.QUERIES}
ORACLES: dict = {**detecting.ORACLES, **serving.ORACLES, **extra.ORACLES, **flows.ORACLES, **varied.ORACLES}
