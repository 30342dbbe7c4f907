"""Shared table helpers of the llm operators: written intermediates, checked broadcasts, Arrow slices."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecospark.functions.cols import c
from ecospark.operators.joins import counted_lookup
from ecospark.session import new_folder

#: rows of (at most) two longs and a flag a broadcast may hold: about 64 MB as a hash relation
BROADCAST_ROWS = 1_000_000


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written as Parquet (with the writer's ``options``) in the shared checkpoint folder and read again: later jobs
    start from the files, so a lost executor never replays what came before. ``session.cleanup`` removes the folder."""
    spark = df.sparkSession
    path = new_folder(spark, "llm")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it is counted to hold at most ``rows`` rows; else unchanged, so that the
    join shuffles. ``df`` should be a written table: it is counted first."""
    return F.broadcast(df) if df.count() <= rows else df


def column(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` cast to ``kind``; null of that type if the table has no such column."""
    return (c(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose texts hold about ``limit`` bytes (one row at least), so that a
    task's arrays stay bounded whatever the batch size."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        sizes = [x or 0 for x in pa.compute.binary_length(texts).to_pylist()]
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)
    release()


#: bytes of an Arrow batch that goes to a Python worker
ARROW_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is. Its session's bound on the bytes of an Arrow batch is lowered to ``ARROW_BYTES`` (never raised): rows of
    whole texts are long, and by default a batch of them takes up to 64 MB on either side of each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > ARROW_BYTES or int(now) <= 0:
        conf.set(name, str(ARROW_BYTES))
    return df


def release() -> None:
    """Give freed memory back to the system at the end of a task's input: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


_KEPT: dict[tuple, Any] = {}


def kept(make: Callable[..., Any], *args: Any) -> Any:
    """``make(*args)``, kept by a Python worker for its later tasks until it needs another such table: workers outlive their stage,
    and would otherwise hold the tables of every stage they served."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[key] = make(*args)
        release()
    return _KEPT[key]


#: rows of a key of 16 bytes and two longs that :func:`lookup` broadcasts: about 64 MB
LOOKUP_ROWS = 250_000


def lookup(rows: DataFrame, side: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left-joined to ``side``, a written table with one row per ``key`` whose ``weight`` counts the rows of that key:
    broadcast if counted small, else only its heaviest keys are and the others shuffled."""
    return counted_lookup(rows, side, [key], weight, LOOKUP_ROWS)
