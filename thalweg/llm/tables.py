"""Helpers shared by the training-data operators: inputs, written tables, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.session import written


#: Rows that a part of in_order() holds, on average at most.
PART_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """(docs whose columns but the used ones have names that no operator uses; docs' own columns of it, as they were)."""
    names = [c if c in used else f"own_column_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def free_name(base: str, *frames: DataFrame) -> str:
    """base, or base with underscores, such that no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids (doc_id); null ids match one another."""
    key = free_name("kept_id", docs)
    return docs.join(ids.select(F.col("doc_id").alias(key)).distinct(), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def runs_of_texts(column, most: int):
    """(place of the first, number of texts) of runs of an Arrow column of texts with so many bytes together, or a single longer one."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("i8"))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b - a
        a = b


def text_runs(column, most: int):
    """(place of the first, texts as bytes) of each of these runs.

    Only one run is held outside of Arrow's memory; null texts are empty.
    """
    for at, n in runs_of_texts(column, most):
        yield at, [t or b"" for t in column.slice(at, n).to_pylist()]


def in_order(df: DataFrame, *columns: str, sums: dict[str, str] | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Number the rows of df from 0 in the order of columns, in column `position`.

    sums: column -> name of a new column with the sum of that column over all rows
    before this one. keep: the columns that the result has, if not all. Rows are dealt out by range; each part numbers its own rows, and a
    table of one row for each part gives what stands before it. No task holds all rows.
    Rows that agree in all columns of the order are numbered in any order.
    """
    sums = sums or {}
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    names = list(keep or df.columns)
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)

    def number(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, rows, before = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0)
        for b in batches:
            n = b.num_rows
            columns = [b.column(i) for i in range(len(names))] + [pa.array(np.full(n, part, "i4")), pa.array(np.arange(rows, rows + n))]
            for c in sums:
                total = np.cumsum(b.column(names.index(c)).to_numpy(zero_copy_only=False).astype("i8"))
                columns.append(pa.array(before[c] + np.concatenate([[0], total[:-1]]).astype("i8")))
                before[c] += int(total[-1]) if n else 0
            rows += n
            yield pa.RecordBatch.from_arrays(columns, [*names, "_part", "_row", *(f"_{c}_before" for c in sums)])

    own = (
        df.repartitionByRange(parts, *columns)
        .sortWithinPartitions(*columns)
        .select(*names)
        .mapInArrow(number, schema + ", _part int, _row long" + "".join(f", _{c}_before long" for c in sums))
    )
    own = written(own, "ordered")
    ends = own.groupBy("_part").agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in sums))
    offsets, so_far = [], [0] * (1 + len(sums))
    for r in sorted(ends.collect()):  # one row for each part
        offsets.append((r["_part"], *so_far))
        so_far = [a + b for a, b in zip(so_far, r[1:], strict=True)]
    starts = spark.createDataFrame(offsets or [(0, *so_far)], "_part int, _rows_off long" + "".join(f", _{c}_off long" for c in sums))
    return own.join(F.broadcast(starts), "_part").select(
        *names, (F.col("_row") + F.col("_rows_off")).alias("position"), *((F.col(f"_{c}_before") + F.col(f"_{c}_off")).alias(new) for c, new in sums.items())
    )
