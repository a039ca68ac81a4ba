"""Arrow batches as the operators use them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: UTF-8 bytes of white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(0x41, 0x5B))


def byte_map(lower: bool, blank: bytes) -> bytes:
    """A table for ``bytes.translate``: A-Z to lower case if asked for, ``blank`` to a space."""
    table = bytearray(range(256))
    if lower:
        for byte in UPPER:
            table[byte] = byte + 32
    for byte in blank:
        table[byte] = 0x20
    return bytes(table)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that what is built per text stays small. No copy is made."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def replaced(batch: pa.RecordBatch, values: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with the columns of these names replaced or added at the end."""
    names = [field.name for field in batch.schema]
    arrays = [values[name] if name in values else batch.column(i) for i, name in enumerate(names)]
    arrays += [array for name, array in values.items() if name not in names]
    names += [name for name in values if name not in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
