"""Methods by name, and how to add one."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame

from ..params import Params
from ..workspace import Workspace
from . import bloom, exact, hybrid, minhash
from .survivors import keep

#: ``(df, params, work) -> DataFrame(pos, owner_pos)`` of the rows to drop
Method = Callable[[DataFrame, Params, Workspace], DataFrame]

_METHODS: dict[str, Method] = {
    "exact": exact.dropped,
    "minhash": minhash.dropped,
    "bloomfilter": bloom.dropped,
    "minhash_bloom_hybrid": hybrid.dropped,
}


def register(name: str, method: Method) -> None:
    """Make ``method`` available under ``name``, replacing any earlier one."""
    _METHODS[name] = method


def method(name: str) -> Method:
    if name not in _METHODS:
        raise ValueError(
            f"unknown de-duplication method {name!r}; available: {', '.join(sorted(_METHODS))}"
        )
    return _METHODS[name]


def deduplicate(df: DataFrame, params: Params, work: Workspace | None = None) -> DataFrame:
    """The rows of ``df`` that survive ``params.method``, with all columns."""
    work = work or Workspace(df.sparkSession)
    return keep(df, method(params.method)(df, params, work), params)
