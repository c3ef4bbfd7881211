"""Streams over append-only logs. Each has a batch form in ``partwise.plans``."""
