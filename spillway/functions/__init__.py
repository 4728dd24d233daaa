"""Scalar expressions."""

from .expressions import Dialect, column, condition, rewrite

__all__ = ["Dialect", "column", "condition", "rewrite"]
