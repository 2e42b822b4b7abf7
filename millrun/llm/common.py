"""Helpers shared by the training-data operators: reading, scratch tables, size-checked broadcast, row groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrun.session import ensure_checkpoint_dir

#: A side is broadcast only when its serialised columns are proven to hold at most this many bytes.
BROADCAST_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage, so that several consumers see one evaluation and a lost executor costs a
    re-read, not a re-computation. The folder is new on every call.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if the rows of ``df`` (written before, so that counting is cheap) take at most ``max_bytes``."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
    total = df.agg(F.sum(size)).first()[0]
    return (total or 0) <= max_bytes


def column_arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Yield ``(key, value columns)`` for each run of equal keys (the first ``n_keys`` columns, not null).

    The input must be sorted by these keys within the task; a group may span batches.
    """
    key, parts = None, []

    def joined():
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = column_arrays(batch)
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols[:n_keys]:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for s, e in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            k = tuple(c[s] for c in cols[:n_keys])
            if k != key:
                if key is not None:
                    yield key, joined()
                key, parts = k, []
            parts.append([c[s:e] for c in cols[n_keys:]])
    if key is not None:
        yield key, joined()
