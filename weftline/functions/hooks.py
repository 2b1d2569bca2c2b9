"""Places where an outer model or tokenizer comes in: functions on Arrow batches inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.functions.batches import small_parts


def score(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], out_type: str = "double", name: str = "score") -> DataFrame:
    """``df`` with the column ``name`` that ``fn`` makes of each batch of rows; no shuffle, order kept within the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: fn(batch)})

    return df.mapInPandas(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` {out_type}").fields]))


def tokens(fn: Callable[[pd.Series], pd.Series]):
    """A column function that counts tokens with ``fn``, some texts at a time; 0 for a null text."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        counts = [pa.array([], pa.int32())]
        for part in small_parts(texts, texts):
            own = part.to_pandas()
            counts.append(pa.Array.from_pandas(fn(own.fillna("")).where(own.notna(), 0).astype("int32")))
        return pa.concat_arrays(counts)

    return count
