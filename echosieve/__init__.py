"""Exact and near-copy removal for text corpora on Spark."""

from .operators.registry import deduplicate, method, register
from .params import BandShape, BloomShape, Params
from .plans.batch import RunResult, run
from .workspace import Workspace

__all__ = [
    "BandShape", "BloomShape", "Params", "RunResult", "Workspace",
    "deduplicate", "method", "register", "run",
]
