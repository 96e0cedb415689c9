"""Registered queries by theme; catalog holds them and their SQL twins."""

from __future__ import annotations

import importlib

THEMES = ("offers", "events", "names", "links", "listings", "feeds", "dictionaries", "stream_queries", "versioned", "hot_events", "stores")


def load_all() -> None:
    """Imports every theme, which registers its queries."""
    for theme in THEMES:
        importlib.import_module(f"tallyframe.plans.{theme}")
