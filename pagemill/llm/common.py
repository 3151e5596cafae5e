"""Small helpers the operators of this package share."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


_FILLED: dict[str, object] = {}  # the operator whose caches this worker process holds


def sole_cache(owner: str, clear) -> None:
    """Empty the caches of whichever other operator ran in this worker process before.

    Spark reuses its workers for all jobs of an application: what one stage has kept would else stay beside the next.
    """
    for other in [x for x in _FILLED if x != owner]:
        _FILLED.pop(other)()
    _FILLED[owner] = clear


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def arrow_rows(batches, schema: pa.Schema, per_batch):
    """Run ``per_batch(*columns as Python lists)`` on every Arrow batch; it returns columns for ``schema``.

    Batches are cut so that one holds at most 16 MB of input, however long the texts are.
    """
    for batch in batches:
        step = max(1, int(batch.num_rows * 16e6 / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            columns = per_batch(*[c.to_pylist() for c in part.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def doc_texts(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and ``columns`` alone: whatever else the table holds cannot clash with what is added."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *columns)


def filtered(docs: DataFrame, keep) -> DataFrame:
    """Whole rows of ``docs`` for which ``keep(list of texts)`` is true; nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            step = max(1, int(batch.num_rows * 16e6 / max(1, batch.nbytes)))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
