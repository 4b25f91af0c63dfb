"""Rows of a task as Arrow batches of a bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS, BYTES = 1000, 2 << 20


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def packed(rows: Iterable[tuple], schema: pa.Schema, most_rows: int = ROWS, most_bytes: int = BYTES) -> Iterator[pa.RecordBatch]:
    """All rows, in order. A batch is given as soon as it has so many rows, or so many bytes in its texts and binaries: a task holds one
    batch, whatever its input has, and few rows don't cost a batch each."""
    own: list[tuple] = []
    size = 0
    for row in rows:
        own.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(own) >= most_rows or size >= most_bytes:
            yield _batch(own, schema)
            own, size = [], 0
    if own:
        yield _batch(own, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, f.type) for values, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
