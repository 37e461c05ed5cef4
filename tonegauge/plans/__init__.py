"""Whole-thread plans."""

from .score import score_threads

__all__ = ["score_threads"]
