"""One fixed-width column in a file that is read through a memory map.

Header of 32 bytes: magic, version (u32), rows (i32), type, has nulls, two free
bytes, bytes of null bits (i32), bytes of values (i32); then null bits, then values.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa

from plinth.errors import FormatError
from plinth.sources.batchfile import fixed_values, null_bits, to_column, type_of
from plinth.types import ColumnType

#: Fixed values of the format.
MAGIC, VERSION, HEADER = b"RNBFCOL1", 1, 32


def write(path: str, column: pa.Array) -> None:
    kind = type_of(column.type)
    if not kind.fixed_width:
        raise FormatError("text has no fixed width")
    nulls, values = null_bits(column), fixed_values(column, kind)
    header = MAGIC + struct.pack("<Ii2B2xii4x", VERSION, len(column), kind.code, bool(nulls), len(nulls), len(values))
    with open(path, "wb") as file:
        file.write(header + nulls + values)


def read(path: str) -> pa.Array:
    size = os.path.getsize(path)
    if size < HEADER:
        raise FormatError("the column file is shorter than its header")
    data = np.memmap(path, np.uint8, "r")
    if data[:8].tobytes() != MAGIC:
        raise FormatError("this is no column file")
    version, rows, code, has_nulls, null_size, value_size = struct.unpack("<Ii2B2xii", data[8:28].tobytes())
    if version != VERSION:
        raise FormatError(f"column files of version {version} can't be read")
    if rows < 0:
        raise FormatError("a column can't have fewer rows than none")
    if code >= ColumnType.UTF8.code:
        raise FormatError(f"type {code} has no fixed width")
    kind = list(ColumnType)[code]
    if value_size != rows * kind.value[3] or null_size != ((rows + 7) // 8 if has_nulls else 0):
        raise FormatError("sizes don't fit rows and type")
    if size < HEADER + null_size + value_size:
        raise FormatError("the column file ends too early")
    middle = HEADER + null_size
    return to_column(kind, data[middle : middle + value_size], data[HEADER:middle].tobytes(), rows)
