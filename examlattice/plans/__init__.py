"""Registered queries and their SQL twins."""

from . import checks, guarded  # noqa: F401  register their queries and twins
