"""Event aggregates that run unchanged on a batch or a streaming DataFrame."""
