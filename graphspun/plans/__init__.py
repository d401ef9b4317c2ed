"""Whole queries: page documents over graph tables, and the registered queries over the driver's tables."""
