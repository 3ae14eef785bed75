"""Text primitives shared by the operators."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and \t \n \v \f \r, and nothing else. `bytes.split()` splits at the same six.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a class for Java's and RE2's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of `text` as an array; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


#: Rows, and bytes of texts, that an operator has as Python objects at a time; a row at least. Spark itself ends an Arrow
#: batch at 64 MB.
ROWS, BYTES = 128, 1 << 23


def pieces(batches, source: str, rows: int = ROWS, most: int = BYTES):
    """Arrow `batches` in slices of at most `rows` rows and `most` bytes of the column `source`, one row at least."""
    import pyarrow.compute as pc

    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(source)), 0).to_pylist()
        start, held = 0, 0
        for k, n in enumerate(sizes):
            if k > start and (k - start >= rows or held + n > most):
                yield whole.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < len(sizes):
            yield whole.slice(start)


def give_back_memory() -> None:
    """Returns what a worker process holds but does not use; workers stay for later tasks, of other stages as well."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
