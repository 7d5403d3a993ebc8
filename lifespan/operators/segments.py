"""Ordered work on units of any size.

A unit may hold a third of all rows, so a window over a whole unit is only opened where
every unit is known to be small.  ``Axis.fit`` counts the rows per unit first.  With no
large unit, one window per unit does the work.  Otherwise each large unit is cut by rank:
a sample of its positions (time and what breaks ties, so also inside one second), drawn by
hash, gives cut points so many rows apart.  Ordered work runs inside ``(unit, segment)``
and one summary row per segment carries the state (row count, last row, running minimum)
over the segment borders.  Only the summary rows of a unit meet in one task: as many as it
has rows over the rows of a segment, however its rows lie in time.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifespan.config import BROADCAST_ROWS, SEGMENT_ROWS

SEG = "__segment"
BLOCK = "__block"
_ROW = "__row"
_CARRY = "__carry"
_CUTS = "__cuts"
#: Sampled positions for each cut point, and cut points of a unit at most.
SAMPLED, MOST_CUTS = 64, 10_000


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a table; channel names may hold dots."""
    return [F.col(f"`{c}`") for c in df.columns]


@dataclass(frozen=True)
class Axis:
    """Unit keys, ordering columns (the first is numeric) and how units are cut.

    ``width`` is the extent of one segment on a dense or even first ordering column; None
    leaves a unit whole.  ``large`` holds the cut points of the units that need some: positions
    on ``cut_order``, rising, each the first of its segment.
    """

    unit: tuple[str, ...]
    order: tuple[str, ...]
    width: float | None = None
    large: DataFrame | None = field(default=None, compare=False)
    cut_order: tuple[str, ...] = ()
    most_cuts: int = 0
    all_cuts: int = 0

    @classmethod
    def fit(cls, df: DataFrame, unit: tuple[str, ...], order: tuple[str, ...], rows: int = SEGMENT_ROWS) -> Axis:
        """Axis for ``df``: whole units where all are small, segments for the large ones.

        The first job reads the unit columns alone; only if there are large units a second one
        draws their positions.  A segment has about ``rows`` rows (``MOST_CUTS`` segments of a unit
        at most, then evenly more); rows of one and the same position stay together.
        """
        from lifespan.sources.storage import cut_lineage

        counts = df.groupBy(*unit).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
        if counts.isEmpty():
            return cls(unit, order)
        # of each unit: segments, and every how many sampled positions one is a cut
        parts = F.least(F.ceil(F.col("__n") / F.lit(rows)), F.lit(MOST_CUTS))
        every = F.least(F.lit(SAMPLED), F.ceil(F.col("__n") / parts))
        sized = cut_lineage(counts.select(*unit, every.alias("__every"), (every * parts / F.col("__n")).alias("__share")))
        fields = tuple(c for c in order if c in df.columns)
        position = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(fields)])
        side = F.broadcast(sized) if sized.count() <= BROADCAST_ROWS else sized
        placed = df.select(*unit, position.alias("__at")).join(side, list(unit))
        drawn = placed.where(F.pmod(F.xxhash64(*unit, "__at", F.lit(1)), F.lit(1 << 30)) < F.col("__share") * F.lit(1 << 30))
        nth = F.row_number().over(Window.partitionBy(*unit).orderBy("__at"))
        cuts = drawn.withColumn("__nth", nth).where(F.col("__nth") % F.col("__every") == 0)
        large = cut_lineage(cuts.groupBy(*unit).agg(F.sort_array(F.collect_list("__at")).alias(_CUTS)))
        size = large.agg(F.max(F.size(_CUTS)), F.sum(F.size(_CUTS))).first()
        return cls(unit, order, None, large, fields, size[0] or 0, size[1] or 0)

    @property
    def whole_units(self) -> bool:
        return self.width is None and self.large is None

    @property
    def keys(self) -> list[str]:
        return list(self.unit) if self.whole_units else [*self.unit, SEG]

    def dense(self, step: str, rows: int = SEGMENT_ROWS) -> Axis:
        """Axis over a dense position column of the same units."""
        return Axis(self.unit, (step,), None if self.whole_units else float(rows))

    def ordered_by(self, *order: str) -> Axis:
        """The same units and cuts with more ordering columns after the first."""
        return replace(self, order=order)

    def segmented(self, df: DataFrame) -> DataFrame:
        if self.whole_units:
            return df
        t = F.col(self.order[0])
        if self.large is None:
            return df.withColumn(SEG, F.floor(t / F.lit(float(self.width))))
        cut = (
            df.join(F.broadcast(self.large), list(self.unit), "left")
            if self.all_cuts <= BROADCAST_ROWS
            else spread_join(df, self.large, list(self.unit), "left")
        )
        return cut.withColumn(SEG, self._cuts_passed()).drop(_CUTS)

    def _cuts_passed(self) -> Column:
        """How many cut points are not behind the row, by halving their list."""
        kinds = self.large.schema[_CUTS].dataType.elementType.fields
        if self.order[: len(kinds)] == self.cut_order:
            own = F.struct(*[F.col(c).cast(k.dataType).alias(k.name) for c, k in zip(self.order, kinds)])
            passed = lambda cut: cut <= own
        else:  # another order of ties: rows of one time stay together
            own = F.col(self.order[0]).cast(kinds[0].dataType)
            passed = lambda cut: cut["p0"] <= own

        def halve(s: Column, _: Column) -> Column:
            middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
            right = passed(F.get(F.col(_CUTS), middle))
            low, high = F.when(right, middle + 1).otherwise(s["low"]), F.when(right, s["high"]).otherwise(middle)
            return F.when(s["low"] < s["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(s)

        start = F.struct(F.lit(0).alias("low"), F.size(_CUTS).alias("high"))
        turns = F.sequence(F.lit(1), F.lit(max(1, self.most_cuts.bit_length())))
        return F.coalesce(F.when(F.col(_CUTS).isNotNull(), F.aggregate(turns, start, halve, lambda s: s["low"])), F.lit(0))

    def local(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def running(self):
        return self.local().rowsBetween(Window.unboundedPreceding, 0)

    def across(self):
        return Window.partitionBy(*self.unit).orderBy(SEG)

    def before(self):
        return self.across().rowsBetween(Window.unboundedPreceding, -1)

    def whole(self):
        return Window.partitionBy(*self.unit)

    def position(self) -> Column:
        return F.struct(*self.order)


def row_numbers(df: DataFrame, axis: Axis, name: str = "step", total: str | None = None) -> DataFrame:
    """Zero-based row position inside each unit, optionally with the unit's row count."""
    if axis.whole_units:
        numbered = df.withColumn(name, (F.row_number().over(axis.local()) - 1).cast("long"))
        return numbered.withColumn(total, F.count(F.lit(1)).over(axis.whole())) if total else numbered
    rows = axis.segmented(df)
    counts = rows.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias(_CARRY))
    offsets = [F.coalesce(F.sum(_CARRY).over(axis.before()), F.lit(0)).alias("__offset")]
    if total:
        offsets.append(F.sum(_CARRY).over(axis.whole()).alias(total))
    offsets = counts.select(*axis.keys, *offsets)
    numbered = rows.withColumn(_ROW, F.row_number().over(axis.local()))
    return (
        numbered.join(offsets, axis.keys)
        .withColumn(name, F.col("__offset") + F.col(_ROW) - 1)
        .drop(SEG, _ROW, "__offset")
    )


def unit_values(df: DataFrame, axis: Axis, values: dict[str, tuple]) -> DataFrame:
    """Attach aggregates of the whole unit to each of its rows.

    ``values`` maps a name to ``(aggregate, merge)``: the aggregate runs per segment,
    ``merge`` combines the segment results of a unit.  Rows meet the result on
    ``(unit, segment)``, so the rows of a huge unit are never joined on the unit alone.
    """
    if axis.whole_units:
        # a whole-unit aggregate needs no order, but the rows of a unit are few here
        return df.select(*columns_of(df), *[agg.over(axis.whole()).alias(n) for n, (agg, _) in values.items()])
    rows = axis.segmented(df)
    parts = rows.groupBy(*axis.keys).agg(*[agg.alias(f"__part_{n}") for n, (agg, _) in values.items()])
    merged = parts.select(
        *axis.keys, *[merge(f"__part_{n}").over(axis.whole()).alias(n) for n, (_, merge) in values.items()]
    )
    return rows.join(merged, axis.keys).drop(SEG)


def spread_join(df: DataFrame, units: DataFrame, keys: list[str], how: str, rows: int = SEGMENT_ROWS) -> DataFrame:
    """Join rows to a table with one row per key when a single key may hold most rows.

    Keys are counted first.  The rows of a key with more than ``rows`` of them spread over as many
    salts as that takes, and its row on the other side is repeated once per salt; all other keys are
    joined as they are.  The salt comes from the row itself, so a repeated task gives the same one.
    Rows without a key match nothing and are spread too.
    """
    from lifespan.sources.storage import cut_lineage

    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    if counts.isEmpty():
        return df.join(units, keys, how)
    hot = cut_lineage(counts.select(*keys, F.ceil(F.col("__n") / F.lit(rows)).cast("int").alias("__salts")))
    side = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    none = any_of([F.col(k).isNull() for k in keys])
    salts = F.when(none, 64).otherwise(F.coalesce("__salts", F.lit(1)))
    salted = df.join(side, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*columns_of(df)), salts).cast("int")).drop("__salts")
    copies = units.join(side, keys, "left")
    copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def previous_row(df: DataFrame, axis: Axis, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Values of the row before, also when that row lies in an earlier segment."""
    return _neighbour(df, axis, columns, prefix, forward=False)


def next_row(df: DataFrame, axis: Axis, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Values of the row after, also when that row lies in a later segment."""
    return _neighbour(df, axis, columns, prefix, forward=True)


def _neighbour(df, axis, columns, prefix, forward):
    if axis.whole_units:
        shift = F.lead if forward else F.lag
        return df.select(*columns_of(df), *[shift(c).over(axis.local()).alias(prefix + c) for c in columns])
    rows = axis.segmented(df)
    pick = F.min_by if forward else F.max_by
    shift = F.lead if forward else F.lag
    # a single numeric position keeps this a hash aggregation
    position = F.col(axis.order[0]) if len(axis.order) == 1 else axis.position()
    edges = rows.groupBy(*axis.keys).agg(*[pick(F.col(c), position).alias(f"__edge_{c}") for c in columns])
    carried = edges.select(
        *axis.keys, *[shift(f"__edge_{c}").over(axis.across()).alias(f"__edge_{c}") for c in columns]
    )
    window = axis.local()
    at_edge = shift(F.lit(True)).over(window).isNull()
    picked = [
        F.when(at_edge, F.col(f"__edge_{c}")).otherwise(shift(c).over(window)).alias(prefix + c) for c in columns
    ]
    return rows.join(carried, axis.keys).select(*columns_of(df), *picked)


def running_min(df: DataFrame, axis: Axis, value: str, name: str) -> DataFrame:
    """Smallest value seen so far in the unit."""
    if axis.whole_units:
        return df.withColumn(name, F.min(value).over(axis.running()))
    rows = axis.segmented(df)
    carried = (
        rows.groupBy(*axis.keys)
        .agg(F.min(value).alias(_CARRY))
        .select(*axis.keys, F.min(_CARRY).over(axis.before()).alias(_CARRY))
    )
    return (
        rows.withColumn(_ROW, F.min(value).over(axis.running()))
        .join(carried, axis.keys)
        .withColumn(name, F.least(_ROW, _CARRY))
        .drop(SEG, _ROW, _CARRY)
    )


def running_sum(df: DataFrame, axis: Axis, value: str, name: str) -> DataFrame:
    """Sum of the values seen so far in the unit."""
    if axis.whole_units:
        return df.withColumn(name, F.sum(value).over(axis.running()))
    rows = axis.segmented(df)
    carried = (
        rows.groupBy(*axis.keys)
        .agg(F.sum(value).alias(_CARRY))
        .select(*axis.keys, F.coalesce(F.sum(_CARRY).over(axis.before()), F.lit(0)).alias(_CARRY))
    )
    return (
        rows.withColumn(_ROW, F.sum(value).over(axis.running()))
        .join(carried, axis.keys)
        .withColumn(name, F.col(_ROW) + F.col(_CARRY))
        .drop(SEG, _ROW, _CARRY)
    )


def last_known(df: DataFrame, axis: Axis, value: str, name: str) -> DataFrame:
    """Latest non-null value at or before each row."""
    return last_known_columns(df, axis, {value: name})


def last_known_columns(df: DataFrame, axis: Axis, columns: dict[str, str]) -> DataFrame:
    """``last_known`` for several columns at once; maps a value column to its new name."""
    local = {n: F.last(v, ignorenulls=True).over(axis.running()) for v, n in columns.items()}
    if axis.whole_units:
        return df.select(*columns_of(df), *[c.alias(n) for n, c in local.items()])
    rows = axis.segmented(df)
    position = F.col(axis.order[0]) if len(axis.order) == 1 else axis.position()
    latest = [
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), position)).alias(f"{_CARRY}_{n}") for v, n in columns.items()
    ]
    carried = rows.groupBy(*axis.keys).agg(*latest).select(
        *axis.keys,
        *[F.last(f"{_CARRY}_{n}", ignorenulls=True).over(axis.before()).alias(f"{_CARRY}_{n}") for n in columns.values()],
    )
    seen = rows.select("*", *[c.alias(f"{_ROW}_{n}") for n, c in local.items()]).join(carried, axis.keys)
    return seen.select(
        *columns_of(df), *[F.coalesce(f"{_ROW}_{n}", f"{_CARRY}_{n}").alias(n) for n in columns.values()]
    )


def with_halo(
    df: DataFrame, step: str, block: int, before: int = 0, after: int = 0, halo: str = "__halo"
) -> DataFrame:
    """Copy rows near a block border into the neighbouring block.

    ``step`` is a dense position.  Each row gets its own block and, marked as halo,
    every block whose frame of ``before`` earlier or ``after`` later rows reaches it.
    """
    first = F.floor((F.col(step) - F.lit(after)) / F.lit(block))
    last = F.floor((F.col(step) + F.lit(before)) / F.lit(block))
    own = F.floor(F.col(step) / F.lit(block))
    return df.withColumn(BLOCK, F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn(
        halo, F.col(BLOCK) != own
    )


def top_rows(df: DataFrame, unit: list[str], order: list, k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each unit with their places from 0; every partition keeps ``k`` before the exchange."""
    placed = df.withColumn(name, F.row_number().over(Window.partitionBy(*unit).orderBy(*order)))
    return placed.where(F.col(name) <= k).withColumn(name, (F.col(name) - 1).cast("long"))


def rank_by_hash(df: DataFrame, group: list[str], digest: str, name: str, total: str) -> DataFrame:
    """Zero-based rank and size inside a group, ordered by a hex digest.

    Small groups are ranked whole.  The digest is uniform, so its leading digits cut a
    huge group into equal parts.
    """
    slots = df.withColumn("__slot", F.conv(F.substring(digest, 1, 4), 16, 10).cast("long"))
    axis = Axis.fit(slots, tuple(group), ("__slot", digest))
    return row_numbers(slots, axis, name, total).drop("__slot")


def ranked_values(
    counted: DataFrame, group: list[str], value: str, slots: int = 64, whole: bool = False
) -> DataFrame:
    """Row positions covered by the distinct values of each group.

    ``counted`` has one row per group and value with its row count ``n``; ``whole`` says that
    every group has few of them.  Otherwise cut points near the
    quantiles split the distinct values of a group into even slots; the ranks
    inside a slot are exact, whatever the cut points are.  Groups are the features
    of a contract (a few hundred), so their cut points may be shipped.
    """
    if whole:
        return _with_ranks(running_sum(counted, Axis(tuple(group), (value,)), "n", "upto"))
    fractions = [i / slots for i in range(1, slots)]
    cuts = counted.groupBy(*group).agg(
        F.percentile_approx(value, fractions, 10 * slots).alias("__cuts")
    )
    placed = counted.join(F.broadcast(cuts), group).withColumn(
        "__slot", F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    )
    axis = Axis(tuple(group), ("__slot", value), 1.0)
    return _with_ranks(running_sum(placed.drop("__cuts"), axis, "n", "upto")).drop("__slot")


def _with_ranks(summed):
    return summed.withColumns(
        {"rank_from": F.col("upto") - F.col("n"), "rank_to": F.col("upto") - 1}
    ).drop("upto")


def value_flags(column: str, values: list[str]) -> list[Column]:
    """Aggregates that say which of a few values a group has: flags of fixed size, unlike a set, so the
    groups stay in a hash aggregation."""
    return [F.bool_or(F.col(column) == v).alias(f"__has{i}") for i, v in enumerate(values)]


def flagged(values: list[str], present: bool = True) -> Column:
    """The values whose flag is set (or is not), in the order of ``values``."""
    has = [F.coalesce(F.col(f"__has{i}"), F.lit(False)) for i in range(len(values))]
    return F.array_compact(F.array(*[F.when(h if present else ~h, F.lit(v)) for h, v in zip(has, values)]))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
