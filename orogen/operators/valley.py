"""Valley test on the marginal histograms of blocks, as distributed running sums: no histogram is held by one task.

The moving average of a histogram is constant, or strictly monotone within a window of the box's edges, between two positions at
which a point enters or leaves the window. The first and last values of these stretches therefore show every strict turn.
Stretches are dealt by ranges of positions; what a range needs of the others (the count before it, its neighbours' values, the highest
maximum on either side) is joined to it from one row for each range, and there are ``PARTS`` ranges of a dimension at most.

A histogram has a valley if some minimum lies at least ``gap`` below a maximum before it and a maximum after it. For a minimum
only the highest maximum on either side counts, so running maxima decide.

The plans are SQL text: they are made again for every test, and a text is one call where columns are one for each operation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

#: Ranges of one dimension at most, and positions of a range at least (both powers of two).
PARTS, LEAST_PART = 1 << 12, 1 << 10
BOX = "block int, dim int, low bigint, width bigint, n bigint, is_root boolean"
BOXED = "block, dim, low, width, n, is_root"
EULER = 0.5772156649015329
Keep = Callable[[DataFrame, str], DataFrame]


def _as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def harmonic(n: str) -> str:
    """SQL for 1 + 1/2 + .. + 1/n (from 64 on by the asymptotic series, to double precision)."""
    table = ", ".join(f"{x!r}d" for x in accumulate((1 / k for k in range(1, 64)), initial=0.0))
    x = f"cast(greatest({n}, 64) as double)"
    return f"if({n} < 64, element_at(array({table}), cast(least({n}, 63) + 1 as int)), ln({x}) + {EULER}d + 1 / (2 * {x}) - 1 / (12 * {x} * {x}) + 1 / (120 * {x} * {x} * {x} * {x}))"


def box_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """``block, dim, low, width, n, is_root`` of the histograms to test."""
    return spark.createDataFrame(list(rows), BOX)


def stretches(counts: DataFrame, boxes: DataFrame, keep: Keep = _as_is) -> DataFrame:
    """``start, last, part, a, b, held``: where the window of each histogram holds the same points, by rising position in the box; ``a`` and ``b`` are the window's widths there."""
    spark = counts.sparkSession
    events = """
        with box as (select *, width div 20 as step, cast(greatest(ceil(log2(width / {parts})), {bits}) as int) as bits from {boxes} where width div 20 >= 2),
        e as (
          select b.*, inline(array(struct(greatest(0, c.pos - low - step + 1) as start, c.n as more), struct(c.pos - low + step + 1 as start, -c.n as more))) from {counts} c join box b on c.block = b.block and c.dim = b.dim
          union all select *, explode(array(0, step, width - step + 1)), 0 from box)
        select *, shiftright(start, bits) as part from (select block, dim, low, width, n, is_root, step, bits, start, sum(more) as more from e where start < width group by all)"""
    rows = keep(spark.sql(events, counts=counts, boxes=boxes, parts=PARTS, bits=LEAST_PART.bit_length() - 1), "valley-events")
    return spark.sql(
        f"""
        with r as (select block, dim, part, sum(more) as total, min(start) as first from {{rows}} group by 1, 2, 3),
        p as (select block, dim, part, (sum(total) over w) - total as before, lead(first) over w as next from r window w as (partition by block, dim order by part)),
        s as (select x.*, before + sum(more) over (partition by x.block, x.dim, x.part order by start rows between unbounded preceding and current row) as held,
            coalesce(lead(start) over (partition by x.block, x.dim, x.part order by start), next, width) - 1 as last
          from {{rows}} x join p on x.block = p.block and x.dim = p.dim and x.part = p.part)
        select {BOXED}, step, part, start, last, held, {_size("start")} as a, {_size("last")} as b from s""",
        rows=rows,
    )


def _size(at: str) -> str:
    """SQL for the number of positions of the window around one."""
    return f"least(width - 1, {at} + step - 1) - greatest(0, {at} - step) + 1"


def moving_average(rows: DataFrame) -> DataFrame:
    """``block, dim, pos, avg`` at every position of the box: the mean count from width / 20 positions before to one less after, cut at the box."""
    each = rows.selectExpr("block", "dim", "low", "width", "step", "held", "explode(sequence(start, last)) as at")
    return each.selectExpr("block", "dim", "cast(low + at as int) as pos", f"held / ({_size('at')}) as avg")


def ends(rows: DataFrame) -> DataFrame:
    """``part, at, m, held``: the moving average at both ends of every stretch, and with the first one its sum over the stretch."""
    # decimals: the sum does not depend on its order
    rows = rows.selectExpr(*BOXED.split(", "), "part", "start", "last", "a", "b", "held", f"cast(held * if(a = b, (last - start + 1) / a, {harmonic('greatest(a, b)')} - {harmonic('least(a, b) - 1')}) as decimal(38,15)) as whole")
    both = "array(struct(start as at, held / a as m, whole as held), struct(last as at, held / b as m, cast(0 as decimal(38,15)) as held))"
    return rows.selectExpr(*BOXED.split(", "), "part", f"inline(slice({both}, 1, if(start < last, 2, 1)))")


def neighbours(values: DataFrame, more: str = "") -> DataFrame:
    """``values`` with ``prev`` and ``next``, the values beside each in the whole histogram; ``more`` columns are taken over the ranges of a histogram (window ``h``)."""
    return values.sparkSession.sql(
        f"""
        with r as (select {BOXED}, part, min_by(m, at) as first_m, max_by(m, at) as last_m{", sum(held) as total, max(m) as top" if more else ""} from {{values}} group by all),
        p as (select block, dim, part, lag(last_m) over w as prev_m, lead(first_m) over w as next_m{more} from r window w as (partition by block, dim order by part), h as (partition by block, dim))
        select v.*, p.* except (block, dim, part, prev_m, next_m), coalesce(lag(m) over w, prev_m) as prev, coalesce(lead(m) over w, next_m) as next
        from {{values}} v join p on v.block = p.block and v.dim = p.dim and v.part = p.part window w as (partition by v.block, v.dim, v.part order by at)""",
        values=values,
    )


def local_extrema(rows: DataFrame) -> DataFrame:
    """``block, dim, pos, avg, is_max``: strict interior maxima and minima of the moving average."""
    near = neighbours(ends(rows)).where("m > prev and m > next or m < prev and m < next")
    return near.selectExpr("block", "dim", "cast(low + at as int) as pos", "m as avg", "m > prev as is_max")


def turning_points(values: DataFrame, share: float, plateaus: bool, keep: Keep = _as_is) -> DataFrame:
    """``part, at, m, gap, high``: strict maxima and minima within the bounds; beyond the ends lies nothing, so one neighbour decides there (the first value can't be a minimum).

    Maxima are at least ``share`` of the mean, minima that much below the highest value; ``flat`` histograms, whose average stays below the mean count, have none.
    """
    bounds = f", {share!r}d * cast((sum(total) over h) as double) / width as least_high, (max(top) over h) as top, not is_root and (max(top) over h) < n / width as flat"
    near = neighbours(values, bounds)
    if plateaus:  # runs of equal values count as one
        near = neighbours(keep(near.where("prev is null or prev <> m").drop("prev", "next"), "valley-plateaus"))
    high = "(prev is null or m > prev) and (next is null or m > next) and m >= least_high"
    low = "m < prev and (next is null or m < next) and m <= top - least_high"
    near = near.where(f"(prev is not null or next is not null) and not flat and ({high} or {low})")
    return near.selectExpr("block", "dim", "part", "at", "m", "greatest(1d, least_high) as gap", f"{high} as high")


def verdicts(counts: DataFrame, boxes: DataFrame, share: float = 0.10, plateaus: bool = False, keep: Keep = _as_is) -> DataFrame:
    """``block, dim, found, further`` from ``block, dim, pos, n``: whether a histogram has a valley, and if not, whether it is worth looking at further dimensions.

    Histograms that are too narrow, flat or without turns give no row; that counts as neither. ``keep`` may write the tables
    from which rows and what their ranges need of others are both taken, so that they are made once.
    """
    points = keep(turning_points(keep(ends(stretches(counts, boxes, keep)), "valley-ends"), share, plateaus, keep), "valley-turns")
    ranges, within = "partition by block, dim order by part", "partition by v.block, v.dim, v.part order by at"
    before, after = "rows between unbounded preceding and 1 preceding", "rows between 1 following and unbounded following"
    return counts.sparkSession.sql(
        f"""
        with r as (select block, dim, part, max(if(high, m, null)) as peak from {{points}} group by 1, 2, 3),
        p as (select block, dim, part, max(peak) over ({ranges} {before}) as earlier, max(peak) over ({ranges} {after}) as later from r),
        s as (select v.block, v.dim, m, gap, high, greatest(earlier, max(if(high, m, null)) over ({within} {before})) as left_, greatest(later, max(if(high, m, null)) over ({within} {after})) as right_
          from {{points}} v join p on v.block = p.block and v.dim = p.dim and v.part = p.part),
        d as (select block, dim, max(coalesce(m <= left_ - gap and right_ >= m + gap, false)) as found, max(coalesce(m <= left_ - gap, false)) as falls, max(left_ is not null and right_ is not null) as turns from s where not high group by 1, 2)
        select block, dim, found, not found and falls and turns as further from d""",
        points=points,
    )


def has_valley(results: Sequence[tuple[bool, bool]], mode: str = "first_dim") -> bool:
    """Whether a block's histogram falls and rises again by a share of its mean; ``results`` of its dimensions in order.

    ``first_dim`` stops at the first dimension that fails early; ``any_dim`` tries all.
    """
    for found, further in results:
        if found:
            return True
        if not further and mode == "first_dim":
            return False
    return False
