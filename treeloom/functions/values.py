"""Functions of a text whose values repeat: each value of a batch once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Values that a task remembers at most.
KNOWN = 20_000


def per_value(rows: DataFrame, column: str, f: Callable[[str | None], tuple[str | None, ...]], names: tuple[str, ...]) -> DataFrame:
    """``rows`` with text columns ``names`` in place of ``column``: what ``f`` gives for its value, null included. Values pass through Arrow as a dictionary."""
    rest = [c for c in rows.columns if c != column]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple] = {}
        for batch in batches:
            coded = batch.column(column).dictionary_encode(null_encoding="encode")
            values = coded.dictionary.to_pylist()
            if len(known) + len(values) > KNOWN:
                known.clear()
            known |= {v: f(v) for v in values if v not in known}
            got = [known[v] for v in values]
            texts = [pa.array([x[k] for x in got], pa.string()).take(coded.indices) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], *texts], [*rest, *names])

    return rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in rest], *[f"{n} string" for n in names]]))
