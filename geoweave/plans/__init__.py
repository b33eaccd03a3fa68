"""Registered queries: one or more a survey operator, each with the SQL that must give the same rows."""

from . import motion, search, spatial, tiles  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
