"""Ordered folds: state carried down the ordered rows of every key, in one pass and constant memory.

For rules whose next step depends on earlier decisions (budgets, leases, greedy chunks), which
neither windows nor joins express.  Rows of a key are sorted within one task and streamed through
it in Arrow batches; nothing is gathered, so a key may be of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[[object, tuple], tuple[object, tuple]]


def ordered_fold(df: DataFrame, key: list[str], order: list[str], reads: list[str], start: object, step: Step, adds: str) -> DataFrame:
    """Adds the columns ``adds`` to ``df``.

    ``step(state, values of reads)`` gives the next state and the values of the new columns; the
    state is ``start`` at the first row of a key.
    """
    new = T.StructType.fromDDL(adds)
    taken = {f.name for f in new.fields}
    kept = [f for f in df.schema.fields if f.name not in taken]
    types = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), start
        for batch in batches:
            at = batch.schema.get_field_index
            keys = zip(*(batch.column(at(k)).to_pylist() for k in key), strict=True)
            out = []
            for k, values in zip(keys, zip(*(batch.column(at(r)).to_pylist() for r in reads), strict=True), strict=True):
                if k != last:
                    last, state = k, start
                state, made = step(state, values)
                out.append(made)
            cols = list(zip(*out, strict=True)) or [()] * len(new.fields)
            yield pa.RecordBatch.from_arrays([*(batch.column(at(f.name)) for f in kept), *(pa.array(c, t.type) for c, t in zip(cols, types, strict=True))], names=[*(f.name for f in kept), *types.names])

    dealt = df.repartition(*key).sortWithinPartitions(*key, *order)
    return dealt.mapInArrow(run, T.StructType([*kept, *new.fields]))
