"""Adding columns to rows slice by slice, in the order in which Spark hands them over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweave.llm.words import SLICE_BYTES, slices


def add_columns(df: DataFrame, text: str, ddl: str, compute: Callable[..., dict[str, list | pa.Array]],
                drop: tuple[str, ...] = (), limit: int = SLICE_BYTES, also: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop`` plus the columns that ``compute`` derives from the texts of a slice.

    ``compute`` gets the columns ``also`` after the texts. A column of ``df`` with the name of a new one is replaced. Rows keep their order and number.
    """
    new = T._parse_datatype_string(ddl)
    names = set(new.names) | set(drop)
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + new.fields)
    arrow = to_arrow_schema(schema)
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, limit):
                got = compute(*(part.column(part.schema.get_field_index(c)) for c in (text, *also)))
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                for f in new.names:
                    a = got[f] if isinstance(got[f], pa.Array) else pa.array(got[f], arrow.field(f).type)
                    columns.append(a.cast(arrow.field(f).type))
                yield pa.RecordBatch.from_arrays(columns, names=keep + new.names)

    return df.mapInArrow(run, schema)
