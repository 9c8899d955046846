"""Running sums in order, in each group, however large a group is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._common import partitions, prepare, scratch


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], part: str = "_part") -> DataFrame:
    """df with, for each name in `sums`, the sum of that column over the rows of the group that come before.

    by: columns without nulls; order: columns; sums: new column -> column of longs without nulls. Rows that tie in all of them
    come in any order. The rows are dealt to ranges of (by, order), so that a group may lie in many parts and even rows
    that tie are split; each task adds up its own part, and the parts' totals (a row for each part and group) are added on. `part`
    names the part in the result: rows of a group are in order by part, then by the sums.
    """
    spark = df.sparkSession
    prepare(spark)
    keys, tie = [*by, *order], "_tie"
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys, tie).sortWithinPartitions(*keys, tie)
    dealt = dealt.drop(tie).withColumn(part, F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, *[T.StructField(name, T.LongType()) for name in sums]])

    def run(batches):
        last, carried = None, dict.fromkeys(sums, 0)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in by:
                col = b.column(b.schema.get_field_index(c))
                new[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            key = [b.column(b.schema.get_field_index(c))[0].as_py() for c in by]
            new[0] = key != last
            last = [b.column(b.schema.get_field_index(c))[n - 1].as_py() for c in by]
            starts = np.flatnonzero(new)
            group = np.cumsum(new)  # 0: goes on with the group of the batch before
            out = []
            for name, c in sums.items():
                v = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(v) - v
                base = np.concatenate([[-carried[name]], before[starts]])
                out.append(before - base[group])
                carried[name] = int(out[-1][-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.int64()) for x in out]], [*b.schema.names, *sums])

    local = scratch(dealt.mapInArrow(run, schema))
    totals = local.groupBy(part, *by).agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    if by:
        earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    else:
        earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = scratch(totals.select(part, *by, *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in sums]))
    rows = local.join(offsets, [part, *by])
    return rows.select(*[c for c in local.columns if c not in sums], *[(F.col(name) + F.col(f"_o_{name}")).alias(name) for name in sums])
