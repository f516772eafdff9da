"""Rules that depend on what was decided before, over sorted rows that pass one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_by_one(df: DataFrame, keys: list[str], order: list[str], out: str, step: Callable, kept: list[str]) -> DataFrame:
    """Rows of ``df`` that ``step(state, row)`` gives a value for, as keys, ``kept`` columns and that value (``out``: name and type).

    Spark sorts a key's rows, and they pass one by one; ``step`` holds its state in a dictionary
    that is new for each key, so memory does not grow with the rows.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    kinds = dict(df.dtypes)
    rest = list(dict.fromkeys([*order, *kept]))
    d = df.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], *rest)
    schema = ", ".join([*[f"{n} {kinds[k]}" for n, k in zip(names, keys)], *[f"{k} {kinds[k]}" for k in kept], out])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, {}
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            at, values = [], []
            for i, row in enumerate(zip(*columns)):
                if row[:len(names)] != key:
                    key, state = row[:len(names)], {}
                value = step(state, dict(zip(rest, row[len(names):])))
                if value is not None:
                    at.append(i)
                    values.append(value)
            t = b.take(pa.array(at, pa.int64()))
            columns = [t.column(b.schema.get_field_index(c)) for c in [*names, *kept]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], names=[*names, *kept, out.split()[0]])

    return d.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(fold, schema).toDF(*keys, *kept, out.split()[0])
