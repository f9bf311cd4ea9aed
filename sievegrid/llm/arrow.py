"""Arrow batches in tasks: bounded slices, and columns added beside those of the input."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_ROWS, SLICE_BYTES = 512, 1 << 20
BATCH_ROWS = 1000


def bound_batches(df: DataFrame) -> None:
    """Lets the session send at most BATCH_ROWS rows in an Arrow batch, since texts are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of at most SLICE_ROWS rows and about SLICE_BYTES of column ``text``."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = min(int(np.searchsorted(size, before + SLICE_BYTES, side="right")), at + SLICE_ROWS, batch.num_rows)
        end = max(end, at + 1)
        yield batch.slice(at, end - at)
        at = end


def texts(part: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a slice; null is the empty text."""
    return [x or "" for x in part.column(text).to_pylist()]


def map_slices(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch], list]], added: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns that Python computes from slices of ``df``.

    make() runs once in each task and gives a function from a slice to a list of
    arrays, one for each field of the DDL string ``added``. All columns of ``df``
    but those of ``drop`` pass through, so a row's verdict never has to be joined
    back to its text.
    """
    bound_batches(df)
    kept = [i for i, c in enumerate(df.columns) if c not in drop]
    fields = T.StructType([df.schema.fields[i] for i in kept] + T.StructType.fromDDL(added).fields)
    schema = to_arrow_schema(fields)
    new = [schema.field(i) for i in range(len(kept), len(schema))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                made = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(work(part), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.columns[i] for i in kept), *made], names=[f.name for f in schema])

    return df.mapInArrow(run, fields)
