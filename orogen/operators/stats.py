"""Aggregations over points: one pass, partial sums before any shuffle, exact integers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.functions.geometry import inside


def sums(cols: Sequence[str], wide: bool | None = True) -> list[Column]:
    """Count, sums ``ls*`` and sums of squares ``ss*`` of the coordinates, as decimal(38,0).

    Without ``wide`` as bigint, which is faster: for callers that know count times largest square to be below 2 ** 63. None: as
    bigint, and null where that does not hold the sum.
    """
    add = F.try_sum if wide is None else F.sum
    long = [F.col(c).cast("bigint") for c in cols]
    first = [add(whole(x, wide)) for x in long]
    second = [add(whole(x * x, wide)) for x in long]
    return [F.count(F.lit(1)).alias("n"), *[whole(x, wide, 38).alias(f"ls{i}") for i, x in enumerate(first)], *[whole(x, wide, 38).alias(f"ss{i}") for i, x in enumerate(second)]]


def whole(x: Column, wide: bool | None, digits: int = 19) -> Column:
    return x.cast(f"decimal({digits},0)") if wide else x


def domain(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    bounds = [F.min(c).alias(f"inf{i}") for i, c in enumerate(cols)] + [F.max(c).alias(f"sup{i}") for i, c in enumerate(cols)]
    return df.groupBy(*by).agg(*bounds)


def summaries(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), wide: bool = True) -> DataFrame:
    return df.groupBy(*by).agg(*sums(cols, wide))


def ssq_columns(dims: int) -> list[Column]:
    """``ssq0 ..`` and ``ssq`` from summary columns."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    each = [(exact("n") * exact(f"ss{i}") - exact(f"ls{i}") * exact(f"ls{i}")).cast("double") / F.col("n") for i in range(dims)]
    total = each[0]
    for x in each[1:]:
        total = total + x
    return [*[x.alias(f"ssq{i}") for i, x in enumerate(each)], total.alias("ssq")]


def marginals(df: DataFrame, cols: Sequence[str], block: str | None = None, wide: bool = False) -> DataFrame:
    """Sparse marginals: ``block, dim, pos, cnt, s*, q*`` of the occupied positions of every dimension (``wide`` as for ``sums``)."""
    d = len(cols)
    rows = df.select(F.col(block).alias("block") if block else F.lit(0).alias("block"), *[F.col(c).cast("int").alias(f"x{i}") for i, c in enumerate(cols)])
    rows = rows.selectExpr("block", f"inline(array({', '.join(f'struct({i} as dim, x{i} as pos)' for i in range(d))}))", *[f"x{i}" for i in range(d)])
    number = lambda c: f"cast({c} as decimal(19,0))" if wide else c
    sums = [f"sum({number(f'bigint(x{i})')}) as s{i}" for i in range(d)] + [f"sum({number(f'bigint(x{i}) * x{i}')}) as q{i}" for i in range(d)]
    return rows.groupBy("block", "dim", "pos").agg(F.expr("count(*) as cnt"), *map(F.expr, sums))


def part_shifts(inf: Sequence[int], sup: Sequence[int], least: int = 4, parts: int = 4096) -> list[int]:
    """For each dimension of a box the power of two that cuts it into ``parts`` equal ranges at most, of ``2 ** least`` positions at least."""
    return [max(least, (max(0, b - a) // (parts - 1)).bit_length()) for a, b in zip(inf, sup)]


def part_column(shifts: Sequence[int] | None = None) -> str:
    """SQL for the range of a position; by default ranges of 65,536, so that neither a range nor a dimension's list of ranges has more rows than that."""
    if shifts is None:
        return "shiftright(pos, 16)"
    return f"shiftright(pos, element_at(array({', '.join(map(str, shifts))}), dim + 1))"


def _values(dims: int) -> list[tuple[str, str, str]]:
    """A marginal's column, its running sum and its sum over the dimension."""
    return [("cnt", "n1", "n")] + [(f"s{i}", f"l{i}", f"t{i}") for i in range(dims)] + [(f"q{i}", f"r{i}", f"u{i}") for i in range(dims)]


def part_sums(marginal: DataFrame, dims: int, part: str) -> DataFrame:
    """``block, dim, part`` and its occupied ``positions``; running sums ``n1, l*, r*`` up to and with it, the same before it (``_0``), and ``n, t*, u*`` of the whole block."""
    named = _values(dims)
    totals = marginal.groupBy("block", "dim", F.expr(part).alias("part")).agg(F.expr("count(*) as positions"), *[F.expr(f"sum({c}) as {c}") for c, _, _ in named])
    up, all_ = "over (partition by block, dim order by part rows between unbounded preceding and current row)", "over (partition by block, dim)"
    rows = totals.selectExpr("*", *[f"sum({c}) {up} as {a}" for c, a, _ in named], *[f"sum({c}) {all_} as {b}" for c, _, b in named])
    return rows.selectExpr("block", "dim", "part", "positions", *[f"{a} - {c} as {a}_0" for c, a, _ in named], *[a for _, a, _ in named], *[b for _, _, b in named])


def within_parts(marginal: DataFrame, sums: DataFrame, dims: int, part: str, carried: Sequence[str] = ()) -> DataFrame:
    """Running sums of the positions in the listed ranges: from the range's start, and what lies before it (and ``carried`` columns) joined to it."""
    named, up = _values(dims), "over (partition by block, dim, part order by pos rows between unbounded preceding and current row)"
    before = sums.select("block", "dim", "part", *carried, *[f"{a}_0" for _, a, _ in named], *[b for _, _, b in named])
    rows = marginal.withColumn("part", F.expr(part)).join(before, ["block", "dim", "part"])
    return rows.selectExpr("block", "dim", "pos", *carried, *[f"{a}_0 + sum({c}) {up} as {a}" for c, a, _ in named], *[b for _, _, b in named])


def cumulative(marginal: DataFrame, dims: int, shifts: Sequence[int] | None = None) -> DataFrame:
    """Running sums over positions: ``n1, l*, r*`` at or below each, ``n, t*, u*`` of the whole block.

    In two levels, so that no task holds a whole dimension: within ranges of positions, and over the ranges' totals.
    """
    part = part_column(shifts)
    return within_parts(marginal, part_sums(marginal, dims, part), dims, part)


def split_candidates(cumulated: DataFrame, dims: int) -> DataFrame:
    """``delta``: SSQ removed by cutting after each position that leaves points on both sides."""
    apart = [f"(cast(l{i} as double) / n1 - cast(t{i} - l{i} as double) / (n - n1))" for i in range(dims)]
    return cumulated.where("n > n1").withColumn("delta", F.expr(f"cast(n1 as double) * cast(n - n1 as double) / n * ({' + '.join(f'{d} * {d}' for d in apart)})"))


def best_splits(candidates: DataFrame, dims: int, more: Sequence[Column] = ()) -> DataFrame:
    """The cut of largest gain of each block (ties: larger dimension, then smaller position), and ``more`` sums over its candidates."""
    carried = ["dim", "pos", "n1", "n", "delta", *[f"{k}{i}" for i in range(dims) for k in "lrtu"]]
    top = candidates.groupBy("block").agg(F.expr(f"max_by(struct({', '.join(carried)}), struct(delta, dim, -pos)) as b"), *more)
    return top.selectExpr("block", "b.*", *[c for c in top.columns if c not in ("block", "b")])


def promising_parts(sums: DataFrame, dims: int, lows: Sequence[int]) -> DataFrame:
    """The ranges of ``part_sums`` in which a block's best cut can lie, and ``all_positions``, the number of occupied positions of the block.

    Sums of coordinates above the box's ``lows`` only rise with the position. So within a range the number of points and the sums on the
    left are between those before it and those up to its end, and with them the gain n / (n1 n2) * |l - n1 t / n| ** 2 is at most
    ``bound``. A range is promising if this is not below the gain of any range's end, which is a cut itself.
    """
    kind = "bigint" if sums.schema["l0"].dataType.typeName() == "long" else "decimal(10,0)"
    above = lambda c, count, i: f"cast({c} - cast({int(lows[i])} as {kind}) * {count} as double)"
    rows = sums.selectExpr("*", "n1_0 + 1 as first", "least(n1, n - 1) as last", *[f"{above(f'l{i}_0', 'n1_0', i)} as low{i}" for i in range(dims)], *[f"{above(f'l{i}', 'n1', i)} as high{i}" for i in range(dims)], *[f"{above(f't{i}', 'n', i)} / n as mean{i}" for i in range(dims)])
    reach = " + ".join(f"pow(greatest(abs(high{i} - first * mean{i}), abs(low{i} - last * mean{i})), 2)" for i in range(dims))
    gain = " + ".join(f"pow(high{i} - n1 * mean{i}, 2)" for i in range(dims))
    split = lambda m: f"cast({m} as double) * cast(n - {m} as double)"
    rows = rows.selectExpr(*sums.columns, f"if(first <= last, n / least({split('first')}, {split('last')}) * ({reach}), null) as bound", f"if(n1 < n, n / ({split('n1')}) * ({gain}), null) as gain")
    best = rows.groupBy("block").agg(F.expr("max(gain) as best"), F.expr("sum(positions) as all_positions"))
    # the bound is above every gain in exact arithmetic; the factor covers rounding
    return rows.join(best, "block").where("bound * (1 + 1e-9d) >= best or best is null and bound is not null").drop("bound", "gain", "best")


def bounded_splits(marginal: DataFrame, dims: int, lows: Sequence[int], shifts: Sequence[int] | None = None) -> DataFrame:
    """``best_splits`` of all candidates, found in the promising ranges alone; ``read`` of ``all_positions`` occupied positions lie in these."""
    part = part_column(shifts)
    kept = promising_parts(part_sums(marginal, dims, part), dims, lows)
    rows = split_candidates(within_parts(marginal, kept, dims, part, ["all_positions"]), dims)
    return best_splits(rows, dims, [F.count(F.lit(1)).alias("read"), F.max("all_positions").alias("all_positions")])


def marginal_combine(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Marginals added, the second ``sign`` times (-1: taken away); positions that become empty go."""
    keys = ["block", "dim", "pos"]
    values = [c for c in a.columns if c not in keys]
    both = a.select(*keys, *values).union(b.select(*keys, *[(F.col(c) * sign).alias(c) for c in values]))
    return both.groupBy(*keys).agg(*[F.sum(c).cast(a.schema[c].dataType).alias(c) for c in values]).where("cnt <> 0")


def with_sisters(made: DataFrame, parents: DataFrame, names: DataFrame) -> DataFrame:
    """``made``, and for each row ``parent, small, large`` of ``names`` the marginal of ``large``: the parent's without that of ``small`` in ``made``."""
    values = [c for c in made.columns if c not in ("block", "dim", "pos")]
    kinds = dict(made.dtypes)
    return made.sparkSession.sql(
        f"""
        with own as (select m.*, s.large from {{made}} m left join {{names}} s on m.block = s.small),
        signed as (
          select dim, pos, inline(slice(array(struct(block, {", ".join(values)}), struct(large as block, {", ".join(f"cast(-{c} as {kinds[c]}) as {c}" for c in values)})), 1, if(large is null, 1, 2))) from own
          union all select dim, pos, s.large, {", ".join(values)} from {{parents}} p join {{names}} s on p.block = s.parent)
        select * from (select block, dim, pos, {", ".join(f"cast(sum({c}) as {kinds[c]}) as {c}" for c in values)} from signed group by block, dim, pos) where cnt <> 0""",
        made=made, names=names, parents=parents,
    )


def count_inside(df: DataFrame, cols: Sequence[str], inf: Sequence[int], sup: Sequence[int]) -> DataFrame:
    return df.where(inside(cols, inf, sup)).agg(F.count(F.lit(1)).alias("n"))


def marginal_slice(marginal: DataFrame, inf: int, sup: int) -> DataFrame:
    """The positions of a marginal from ``inf`` to ``sup``, both included."""
    return marginal.where(F.col("pos").between(inf, sup))


def marginal_average(marginal: DataFrame) -> DataFrame:
    """Mean count of the positions of each dimension's box, empty ones included."""
    wide = F.max("pos").cast("bigint") - F.min("pos") + 1
    return marginal.groupBy("block", "dim").agg((F.sum("cnt") / wide).alias("average"))


def jump_threshold(values: DataFrame, column: str, low: int = 0, high: int | None = None) -> DataFrame:
    """``lim, threshold``: among the sorted values from place ``low`` to ``high`` (both included, from 0), the value before the first jump.

    A jump is a ratio of neighbours above mean plus deviation of all ratios (``lim``); without one it is the last value. Equal values
    are one row with their number, so only distinct ones meet in one task (of counts that add up to n, some sqrt(2 n) at most). A ratio to
    zero is a jump. No values give nulls.
    """
    order = Window.orderBy("v")
    rows = values.select(F.col(column).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.col("upto") - 1 if high is None else F.least(F.col("upto") - 1, F.lit(high))
    rows = rows.withColumn("c", last - F.greatest(F.col("upto") - F.col("c"), F.lit(low)) + 1).where("c > 0")
    zero, v = F.col("v") == 0, F.col("v").cast("double")
    rows = rows.withColumn("next", F.lead("v").over(order))
    rows = rows.withColumns({"ratio": F.when(~zero, F.col("next") / F.nullif(v, F.lit(0.0))), "ones": F.when(zero, 0).otherwise(F.col("c") - 1), "hole": zero & ((F.col("c") > 1) | F.col("next").isNotNull())})
    sums = rows.agg(F.sum("ones").alias("ones"), F.count("ratio").alias("k"), F.avg("ratio").alias("mean_"), F.var_pop("ratio").alias("var_"))
    n, mean_, var_ = F.col("ones") + F.col("k"), F.coalesce("mean_", F.lit(1.0)), F.coalesce("var_", F.lit(0.0))
    mean = (F.col("ones") + F.col("k") * mean_) / F.nullif(n, F.lit(0))
    spread = (F.col("k") * (var_ + (mean_ - mean) * (mean_ - mean)) + F.col("ones") * (1 - mean) * (1 - mean)) / F.nullif(n, F.lit(0))
    lim = sums.select(F.coalesce(mean + F.sqrt(spread), F.lit(0.0)).alias("lim"))
    jump = F.col("hole") | (F.col("ratio") > F.col("lim"))
    return rows.join(lim).agg(F.max("lim").alias("lim"), F.coalesce(F.min(F.when(jump, F.col("v"))), F.max("v")).alias("threshold"))
