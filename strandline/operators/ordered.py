"""Ordered scans over long sequences.

Neighbour, hold and running-sum operators need the rows of one log in order. A window partitioned by the log
would put a log that holds a third of all rows into one task. Here the sequence is cut into chunks that keep
the order, every chunk is one window partition, and a small table with one row per chunk carries the state
from chunk to chunk. The table grows with the number of chunks, not with the rows, and only the carried state
joins the rows again: it travels as one extra row per chunk through the same shuffle, so there is no join.

Where the cells are finer than the data, nearly every row would be a chunk with a carrier of its own. ``Chunks.fitting``
therefore measures the rows and takes the widest cells that keep a chunk small; sequences that are all short need none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
ROWS_PER_CHUNK = 1_000_000
CELL_US = 1 << 31  # about 36 minutes: at 400 rows a second fewer than a million rows
FITTED_ROWS = 200_000

_SLOT = "_slot"


def rank_chunk(df: DataFrame, index: str = "record_index", rows: int = ROWS_PER_CHUNK) -> DataFrame:
    """Chunks for sequences ordered by a running row number: at most ``rows`` rows each, whatever the log."""
    return df.withColumn(CHUNK, F.floor(F.col(index) / F.lit(rows)))


class Chunks:
    """How sequences ordered by time are cut: fixed cells of time, the same whatever the data.

    A faster source takes a finer ``cell_us``; a chunk is a plain expression of the time. Without cells every sequence is whole.
    """

    def __init__(self, cell_us: int | None = CELL_US):
        self.cell_us = cell_us

    @classmethod
    def fitting(cls, rows: DataFrame, step_us: int, key: str = "log_id", time: str = "time_us", limit: int = FITTED_ROWS) -> "Chunks":
        """The widest cells in which no key has more than ``limit`` rows and points of a grid of ``step_us``, but none finer than
        ``CELL_US``; none at all where every key has so few. Each width tried is one count, whose results are single numbers.
        """
        timed = rows.where(F.col(time).isNotNull())
        points = F.count(F.lit(1)) + F.floor((F.max(time) - F.min(time)) / F.lit(step_us)) + 1
        most = lambda df, *by: df.groupBy(*by).agg(points.alias("n")).agg(F.max("n")).first()[0] or 0
        if most(timed, key) <= limit:
            return cls(None)
        width = CELL_US
        while width * 8 <= limit * step_us // 2:
            width *= 8
        while width > CELL_US and most(cls(width).add(timed, time), key, CHUNK) > limit:
            width //= 8
        return cls(max(width, CELL_US))

    def add(self, df: DataFrame, time: str = "time_us") -> DataFrame:
        """Chunks are named by their start, so they sort like time."""
        if self.cell_us is None:
            return df.drop(CHUNK)
        return df.withColumn(CHUNK, F.col(time) - F.pmod(F.col(time), F.lit(self.cell_us).cast("bigint")))


    def by_rank(self, df: DataFrame, index: str = "record_index") -> DataFrame:
        """Chunks of a running row number for the same sequences."""
        return df.drop(CHUNK) if self.cell_us is None else rank_chunk(df, index)


WHOLE_CELLS = Chunks()


class Scan:
    """Collects what an ordered pass should compute, then runs it in one shuffle.

    ``previous`` and ``following`` look one row back or ahead; ``last`` is the newest non-missing value at or
    before the row; ``total`` a running sum including the row; ``peak_before`` the running maximum of the
    earlier rows. Rows without a chunk column are sequences that were found to be short: one window each.
    """

    def __init__(self, df: DataFrame, keys, order, chunk: str = CHUNK):
        self.df, self.keys, self.order, self.chunk = df, list(keys), list(order), chunk
        self.specs: list[tuple[str, str, Column]] = []

    def previous(self, alias: str, *columns) -> "Scan":
        return self._add("previous", alias, F.struct(*columns))

    def following(self, alias: str, *columns) -> "Scan":
        return self._add("following", alias, F.struct(*columns))

    def last(self, alias: str, value: Column) -> "Scan":
        return self._add("last", alias, value)

    def total(self, alias: str, value: Column) -> "Scan":
        return self._add("total", alias, value)

    def peak_before(self, alias: str, value: Column) -> "Scan":
        return self._add("peak", alias, value)

    def _add(self, kind: str, alias: str, value: Column) -> "Scan":
        self.specs.append((kind, alias, value))
        return self

    def run(self) -> DataFrame:
        keys, chunk = self.keys, self.chunk
        value = {alias: f"_v_{alias}" for _, alias, _ in self.specs}
        rows = self.df.select("*", *[expr.alias(value[alias]) for _, alias, expr in self.specs])
        if chunk not in self.df.columns:
            whole = Window.partitionBy(*keys).orderBy(*self.order)
            return rows.select("*", *self._results(whole, value)).drop(*value.values())

        place = F.struct(*self.order)
        edges = []
        for kind, alias, _ in self.specs:
            v = F.col(value[alias])
            edges.append({
                "previous": lambda: F.max_by(v, place),
                "following": lambda: F.min_by(v, place),
                "last": lambda: F.max_by(v, F.when(v.isNotNull(), place)),
                "total": lambda: F.sum(v),
                "peak": lambda: F.max(v),
            }[kind]().alias(value[alias]))
        ends = rows.groupBy(*keys, chunk).agg(*edges)

        by_chunk = Window.partitionBy(*keys).orderBy(chunk)
        earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
        before, after = [], []
        for kind, alias, _ in self.specs:
            v = F.col(value[alias])
            if kind == "following":
                after.append(F.lead(v).over(by_chunk).alias(value[alias]))
            else:
                carried = {
                    "previous": lambda: F.lag(v).over(by_chunk),
                    "last": lambda: F.last(v, ignorenulls=True).over(earlier),
                    "total": lambda: F.sum(v).over(earlier),
                    "peak": lambda: F.max(v).over(earlier),
                }[kind]()
                before.append(carried.alias(value[alias]))

        merged = rows.withColumn(_SLOT, F.lit(0))
        for columns, slot in ((before, -1), (after, 1)):
            if columns:
                names = [value[a] for k, a, _ in self.specs if (k == "following") == (slot == 1)]
                carriers = ends.select(*keys, chunk, *columns, F.lit(slot).alias(_SLOT))
                merged = merged.unionByName(carriers.where(_any_present(names)), allowMissingColumns=True)

        local = Window.partitionBy(*keys, chunk).orderBy(_SLOT, *self.order)
        out = merged.select("*", *self._results(local, value)).where(F.col(_SLOT) == 0)
        return out.drop(_SLOT, *value.values())

    def _results(self, local, value: dict[str, str]) -> list[Column]:
        upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ahead_of = local.rowsBetween(Window.unboundedPreceding, -1)
        results = []
        for kind, alias, _ in self.specs:
            v = F.col(value[alias])
            results.append({
                "previous": lambda: F.lag(v).over(local),
                "following": lambda: F.lead(v).over(local),
                "last": lambda: F.last(v, ignorenulls=True).over(upto),
                "total": lambda: F.sum(v).over(upto),
                "peak": lambda: F.max(v).over(ahead_of),
            }[kind]().alias(alias))
        return results


def _any_present(names) -> Column:
    condition = F.lit(False)
    for name in names:
        condition = condition | F.col(name).isNotNull()
    return condition


def changed(previous: str, *columns: str) -> Column:
    """True on the first row and wherever one of the columns differs from the row before."""
    now = F.struct(*columns)
    before = F.struct(*[F.col(f"{previous}.{c}").alias(c) for c in columns])
    return F.col(previous).isNull() | ~now.eqNullSafe(before)


def first_appearances(rows: DataFrame, keys, values, order, chunk: Column | None = None) -> DataFrame:
    """Each distinct combination of ``values`` of a key once, with the ``order`` columns of its first row and its ``place``.

    Repeats meet by a grouped minimum, so tasks drop most of them before the shuffle; no list of a key is ever in one place. The
    places 1, 2, .. then follow the first rows' order through chunks, each of which is a task's work however many values a key
    has. ``chunk`` is an expression of the order columns that rises with them; without one the first order column is a row number.
    Null values are values; rows that tie in ``order`` are placed by their values.
    """
    keys, values, order = list(keys), list(values), list(order)
    firsts = rows.groupBy(*keys, *values).agg(F.min(F.struct(*order)).alias("_first"))
    firsts = firsts.select(*keys, *values, *[F.col(f"_first.{c}").alias(c) for c in order])
    cut = rank_chunk(firsts, order[0]) if chunk is None else firsts.withColumn(CHUNK, chunk)
    return Scan(cut, keys, (*order, *values)).total("place", F.lit(1)).run().drop(CHUNK)
