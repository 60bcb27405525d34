"""Helpers that several operators share: tables, written tables, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from tidemark.sources.storage import new_path, shared_dir, spread, table, written


def chunks(batches: Iterator[pa.RecordBatch], *names: str, rows: int = 512, most: int = 1 << 22) -> Iterator[list[list]]:
    """Columns of ``rows`` rows at a time as Python lists, and fewer where the last column
    holds texts of more than ``most`` bytes together, so that a batch of long texts is
    never held as Python objects at once."""
    for batch in batches:
        at = [batch.schema.get_field_index(n) for n in names]
        text = pa.types.is_string(batch.column(at[-1]).type)
        for part in slices(batch, at[-1], rows, most) if text else (batch.slice(k, rows) for k in range(0, batch.num_rows, rows)):
            yield [part.column(k).to_pylist() for k in at]


def parts_of(texts: list, most: int) -> Iterator[list]:
    """Runs of texts of at most ``most`` characters together, or of one longer text."""
    at = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > at and size + n > most:
            yield texts[at:k]
            at, size = k, 0
        size += n
    if len(texts) > at:
        yield texts[at:]


def slices(batch: pa.RecordBatch, column: int, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows, whose texts have at most ``most`` bytes
    together; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    at = held = 0
    for k, n in enumerate(size):
        if k > at and (held + n > most or k - at == rows):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if batch.num_rows > at:
        yield batch.slice(at)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; none for a null."""
    return (text or "").encode("utf-8", "surrogatepass")


__all__ = ["chunks", "new_path", "parts_of", "shared_dir", "slices", "spread", "table", "utf8", "written"]
