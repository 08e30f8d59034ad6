"""Groups of rows inside a task, read as a stream."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the offsets at which groups begin and the last one ends.

    Rows come sorted by the keys, integers without nulls. Only the group that is still open is
    held back from one batch to the next.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        cuts = borders(table, keys)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]), cuts[:-1]
        held = table.slice(cuts[-2]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, borders(table, keys)


def borders(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
