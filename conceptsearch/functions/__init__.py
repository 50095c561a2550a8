"""Column functions: scoring terms, vector arithmetic and text helpers."""

from conceptsearch.functions.scalar import *  # noqa: F401,F403
