"""Ordered work on keys of any size.

A Spark window sends one partition key to one task. When a single meeting can
hold a third of all rows that task never ends, so ordered operators here work on
slices of a key: keys above ``target`` rows are cut along their order columns,
the window runs inside each slice, and only one summary row per slice is carried
across slice borders. A narrow count by key decides first whether any
key needs this; where none does, the plan is the plain window.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

TARGET_ROWS = 1 << 17
SLICE = "_slice"


#: quantiles a key or slice is cut at in one go, and slice numbers a cut may use
CUTS, STRIDE = 32, 128
LOWEST = -1.7e308


def _numeric(df: DataFrame, order: Sequence[str]) -> list[str]:
    """The order columns up to the first that is no number; later ones cannot cut."""
    kinds, out = {f.name: f.dataType for f in df.schema}, []
    for c in order:
        if not isinstance(kinds[c], T.NumericType):
            break
        out.append(c)
    return out


def _place_value(c: str) -> Column:
    """A column as a double that sorts the same, nulls first."""
    return F.coalesce(F.col(c).cast("double"), F.lit(LOWEST))


def _borders(df: DataFrame, by: Sequence[str], columns: Sequence[str], rows: int) -> DataFrame:
    """Where to cut keys or slices of more than ``rows`` rows: the number of the first column that varies there, and quantiles of it."""
    shares = [k / CUTS for k in range(1, CUTS)]
    varies = [(F.min(c) < F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))) for c in columns]
    cuts = [F.percentile_approx(_place_value(c), F.lit(shares), F.lit(1000)) for c in columns]
    sized = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[v.alias(f"_v{k}") for k, v in enumerate(varies)], *[q.alias(f"_q{k}") for k, q in enumerate(cuts)]
    )
    first = F.coalesce(*[F.when(F.col(f"_v{k}"), F.lit(k)) for k in range(len(columns))])
    chosen = F.coalesce(*[F.when(F.col(f"_v{k}"), F.col(f"_q{k}")) for k in range(len(columns))])
    return sized.filter(F.col("_n") > rows).select(*by, first.alias("_by"), F.array_sort(F.array_distinct(chosen)).alias("_cuts")).filter("_by IS NOT NULL")


def _number(columns: Sequence[str]) -> Column:
    """Number of a row's slice: values between two cuts are one, and each cut is one of its own, as all its rows may be equal."""
    x = F.coalesce(*[F.when(F.col("_by") == k, _place_value(c)) for k, c in enumerate(columns)])
    number = F.size(F.filter("_cuts", lambda b: b < x)) * 2 + F.when(F.array_contains("_cuts", x), 1).otherwise(0)
    return F.coalesce(F.when(F.col("_cuts").isNotNull(), number), F.lit(0)).cast("bigint")


def slice_keys(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], target: int = TARGET_ROWS, depth: int = 6
) -> tuple[DataFrame, bool]:
    """Add a slice number that grows with ``order`` (ascending, nulls first) within each key, and say whether any key was cut.

    A key above ``target`` rows is cut at quantiles of its first order column that varies.
    A value that many rows share is a slice of its own; it is cut again by the next
    column, so rows of one time or priority are told apart by their ids. Slices that are
    still too large are cut up to ``depth`` times. Only keys or slices above their limit
    enter a table of cuts, so it has at most rows / target entries. It is not hinted: the
    adaptive planner broadcasts it when its measured size allows, else the join splits
    the skewed side. Tables of cuts are written down once, so every branch of a plan cuts
    at the same places.
    """
    columns = _numeric(df, [order] if isinstance(order, str) else order)
    whole = df.withColumn(SLICE, F.lit(0).cast("bigint"))
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > target).select(*keys, F.lit(True).alias("_cut"))
    if not columns or hot.isEmpty():
        return whole, False
    cut, at = whole.join(durable(hot), list(keys), "left"), [*keys, SLICE]
    for level in range(depth):
        cuts = durable(_borders(cut.filter("_cut"), at, columns, target if level == 0 else 2 * target))
        if cuts.isEmpty():
            break
        cut = cut.join(cuts, at, "left").withColumn(SLICE, F.col(SLICE) * STRIDE + _number(columns)).drop("_by", "_cuts")
    return cut.drop("_cut"), True


def in_slice(keys: Sequence[str], *order) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    edges: Sequence[Column],
    known: Callable[[DataFrame, WindowSpec], DataFrame],
    cut: bool,
) -> DataFrame:
    """Summarise each slice, let ``known`` look across the summaries, join its columns back.

    ``edges`` are aggregates over a slice. ``known`` gets the summaries and the window
    over a key's slices, and adds what rows of a slice need to know about earlier ones.
    The join is on the partitioning the local windows already have. Without a cut there
    is no earlier slice, so the columns are null.
    """
    ends = df.groupBy(*keys, SLICE).agg(*edges)
    found = known(ends, Window.partitionBy(*keys).orderBy(SLICE))
    if cut:
        return df.join(found, [*keys, SLICE], "left")
    new = [f for f in found.schema if f.name not in (*keys, SLICE)]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in new})


def earlier_slices(over: WindowSpec) -> WindowSpec:
    return over.rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx", target: int = TARGET_ROWS
) -> DataFrame:
    """0-based position of each row within its key; where one has more than ``target`` rows, rows are cut into ranges of key and order by one sampled sort."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    cut = (sizes[0] or 0) > target
    if cut:
        ranges = df.repartitionByRange(2 * sizes[1] // target + 1, *keys, *order)
        # written down, so that every branch sees the same ranges
        rows = durable(ranges.withColumn(SLICE, F.spark_partition_id().cast("bigint")))
    else:
        rows = df.withColumn(SLICE, F.lit(0).cast("bigint"))
    local = rows.withColumn(name, (F.row_number().over(in_slice(keys, *order)) - 1).cast("bigint"))
    if not cut:
        return local.drop(SLICE)
    ends = rows.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(earlier_slices(Window.partitionBy(*keys).orderBy(SLICE)))
    at = [*keys, SLICE]
    before = ends.select(*[F.col(c).alias(f"_{c}") for c in at], F.coalesce(upto, F.lit(0)).alias("_before"))
    return local.join(before, same_key(at)).withColumn(name, F.col(name) + F.col("_before")).drop("_before", *[f"_{c}" for c in at], SLICE)


def same_key(keys: Sequence[str]) -> Column:
    """Whether a row's keys are those of a row with an underscore before their names; null is a key like others."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])


def place_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows placed by key once, ahead of several steps that group by it; adaptive execution sizes the partitions."""
    return df.repartition(*keys)


#: bytes of text that one task takes apart
TASK_TEXT = 1 << 22


def place_texts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows placed by key, in as many partitions as their ``text`` needs: a text that is taken apart grows many times over, so sizes after the shuffle say little."""
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // TASK_TEXT + 1), *keys)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all tasks, where much is made of each: a small table in one file is read by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    The folder is ``spark.checkpoint.dir`` of the session. Only a local session, whose
    tasks all run on this machine, may go without: it gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
