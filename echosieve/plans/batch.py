"""A whole de-duplication run over a corpus at rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import bloom, groups, hybrid, metrics
from ..operators.registry import Method, method
from ..operators.similarity import pair_table
from ..operators.survivors import keep
from ..params import BLOOM_METHODS, Params
from ..sources.readers import limit_chunks, read_corpus, select_part
from ..sources.sinks import output_folder, write_chunks, write_parts
from ..workspace import Workspace, delete, exists


@dataclass(frozen=True)
class RunResult:
    """Where a run wrote its rows, and its reports as DataFrames."""

    path: str
    reports: str
    dropped: DataFrame
    chunk_metrics: DataFrame
    method_metrics: DataFrame | None
    summary: DataFrame
    top_groups: DataFrame | None
    saturation: DataFrame | None


def run(
    spark: SparkSession, params: Params, source: str | DataFrame | None, out: str,
    format: str = "parquet", cluster: bool = True, rows_per_file: int = 0,
    overwrite: bool = False, part_bytes: int | None = None,
) -> RunResult:
    """Read, de-duplicate, write kept rows by chunk, and report.

    With ``part_bytes`` rows are written in parts of at most that size before compression, many
    chunks to a folder, instead of a folder per chunk.

    Below ``out`` lie the result folder named after the parameters, and beside it one
    of the same name with ``_reports``: ``dropped``, ``metrics/chunk``,
    ``metrics/method``, ``metrics/summary``, ``metrics/share``, ``metrics/trend``,
    ``metrics/saturation``, ``pairs`` and ``top_duplicates``.  So runs of different
    methods share an ``out``.  If either is there already the run ends before its
    first job, or with ``overwrite`` replaces both, as a retry does.  Kept rows carry
    ``duplicate_count`` with ``log_duplicates`` and a method that knows owners.
    Intermediate tables are removed at the end, also of a run that fails.
    """
    decide = method(params.method)
    path = f"{out}/{output_folder(params)}"
    reports = f"{path}_reports"
    for target in (path, reports):
        if exists(spark, target):
            if not overwrite:
                raise FileExistsError(f"{target} is there already; see overwrite")
            delete(spark, target)
    source = params.dataset_name if source is None else source
    if source is None:
        raise ValueError("neither a source nor a dataset_name was given")
    work = Workspace(spark)
    try:
        df = (
            read_corpus(spark, source, params, format) if isinstance(source, str)
            else limit_chunks(select_part(source, params), params)
        )
        names = _write(df, params, decide, work, path, reports, cluster, rows_per_file, part_bytes)
    finally:
        work.remove()

    def written(name: str) -> DataFrame | None:
        return spark.read.parquet(f"{reports}/{name}") if name in names else None

    return RunResult(
        path, reports, written("dropped"), written("metrics/chunk"), written("metrics/method"),
        written("metrics/summary"), written("top_duplicates"), written("metrics/saturation"),
    )


def _write(
    df: DataFrame, params: Params, decide: Method, work: Workspace, path: str, reports: str,
    cluster: bool, rows_per_file: int, part_bytes: int | None,
) -> set[str]:
    """Write everything; returns the names of the reports."""
    dropped = decide(df, params, work)
    has_owners = params.method not in BLOOM_METHODS and "owner_pos" in dropped.columns
    counted = has_owners and params.log_duplicates
    kept = (
        groups.with_duplicate_count(df, dropped, params, work) if counted
        else keep(df, dropped, params)
    )
    if part_bytes is None:
        write_chunks(kept, path, params, rows_per_file, cluster)
    else:
        write_parts(kept, path, params, part_bytes, work)
    counts = work.table(metrics.chunk_counts(df, dropped, params), "chunk-counts")
    per_method = metrics.method_metrics(params.method, counts)
    tables = {
        "dropped": dropped,
        "metrics/chunk": metrics.chunk_metrics(counts),
        "metrics/summary": metrics.final_summary(counts, per_method),
        "metrics/share": metrics.unique_share(counts),
        "metrics/trend": metrics.compression_trend(counts),
    }
    if per_method is not None:
        tables["metrics/method"] = metrics.logged(per_method)
    prints = {"bloomfilter": bloom.fingerprints, "minhash_bloom_hybrid": hybrid.fingerprints}
    if params.method in prints:
        rows = work.table(prints[params.method](df, params), "fingerprints")
        tables["metrics/saturation"] = bloom.saturation(
            rows, params.bloom(), params.chunk_size, work
        )
    if has_owners:
        tables["top_duplicates"] = groups.top_groups(df, dropped, params)
    if counted:
        tables["pairs"] = pair_table(groups.pair_sample(df, dropped, params, work))
    for name, table in tables.items():
        table.write.parquet(f"{reports}/{name}")
    return set(tables)
