"""Whole tasks and reports made of the operators."""

from .report import report
from .tasks import run_task

__all__ = ["report", "run_task"]
