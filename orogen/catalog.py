"""Queries of the clustering engine over the shared tables, and the same in SQL.

Most work on points planted in ``lineitem``: two integer coordinates in which the six groups
of return flag and line status are the clusters. SQL therefore knows each phase's
answer from the groups, while the engine has to find them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.functions import exact, geometry
from orogen.operators import refine, stats, valley
from orogen.plans.clustering import Clusterer, Model, block_column, fit
from orogen.sources import points as src

COLS = ["x0", "x1"]
X0 = "cast(l_quantity as int) + cast(round(l_discount * 500) as int) + cast(l_orderkey % 50 as int) + case l_returnflag when 'A' then 0 when 'N' then 200 else 600 end"
X1 = "cast(l_partkey * 7 % 50 + l_orderkey * 3 % 47 + l_linenumber * 11 % 50 as int) + case l_linestatus when 'F' then 0 else 300 end"
POINTS = f"select l_orderkey, l_linenumber, l_returnflag, l_linestatus, {X0} as x0, {X1} as x1 from lineitem"
GROUP = "l_returnflag || l_linestatus"
BIG = "cast(sum({0}) as bigint)"
SUMS = "count(*) as n, " + ", ".join(f"{BIG.format(f'cast(x{i} as bigint)')} as ls{i}" for i in (0, 1)) + ", " + ", ".join(f"{BIG.format(f'cast(x{i} as bigint) * x{i}')} as ss{i}" for i in (0, 1))
WHOLE = "(cast(n * ss0 - ls0 * ls0 + n * ss1 - ls1 * ls1 as double) / n)"
SSQ = "(cast(n * ss{0} - ls{0} * ls{0} as double) / n)"
BOX = ((150, 10), (700, 350))  # a fixed box for the box queries

_models: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", f"{X0} as x0", f"{X1} as x1")


def model_of(spark: SparkSession, sf_dir: str) -> Model:
    """The fitted model of the planted points; fitted once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        _models[key] = fit(planted(spark, sf_dir), COLS)
    return _models[key]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A few driver-side results as a DataFrame."""
    return spark.createDataFrame(rows, schema)


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- sources and sinks -------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, cast(l_quantity as int) as x0, cast(l_linenumber as int) as x1 from lineitem")
def parse_points(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("  "), F.col("l_quantity").cast("int").cast("string"), F.lit(",\t "), F.col("l_linenumber").cast("string")).alias("value"))
    t = src.tokens(F.col("value"))
    return lines.select("l_orderkey", "l_linenumber", *[src.to_int(t[i].cast("int")).alias(f"x{i}") for i in (0, 1)])


@query("select c_custkey, cast(trunc(0.5::double + 0.25::double * cast(trunc(c_acctbal) as int)) as int) as x0 from customer")
def scale_points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", src.to_int(F.col("c_acctbal").cast("int"), 0.25).alias("x0"))


LABELLED = f"""
p as (select row_number() over () as rid, * from ({POINTS})),
g as (select {GROUP} as grp, {SUMS} from p group by 1),
m as (select grp, n, ls0, ls1, ss0, ss1, ls0 / cast(n as double) as c0, ls1 / cast(n as double) as c1, 3.0::double * sqrt({SSQ.format(0)} / n) as r0, 3.0::double * sqrt({SSQ.format(1)} / n) as r1 from g),
a as (select p.*, m.grp, ((c0 - x0) / r0) * ((c0 - x0) / r0) + ((c1 - x1) / r1) * ((c1 - x1) / r1) as d from p, m),
near as (select * from (select *, row_number() over (partition by rid order by d, grp) as k from a) where k = 1 and d <= 1)"""
REFINED = f"""{LABELLED},
s as (select grp, {SUMS} from near group by grp),
f as (select row_number() over (order by ls0 / cast(n as double), ls1 / cast(n as double)) - 1 as label, n, ls0, ls1, ss0, ss1, ls0 / cast(n as double) as c0, ls1 / cast(n as double) as c1,
  sqrt({SSQ.format(0)} / n) as d0, sqrt({SSQ.format(1)} / n) as d1, sqrt({WHOLE} / n) as radius, {WHOLE} as ssq from s)"""
FINAL = f"""{REFINED},
q as (select p.rid, p.l_orderkey, p.l_linenumber, p.x0, p.x1, f.label, ((c0 - x0) / (3.0::double * d0)) * ((c0 - x0) / (3.0::double * d0)) + ((c1 - x1) / (3.0::double * d1)) * ((c1 - x1) / (3.0::double * d1)) as d from p, f),
final as (select l_orderkey, l_linenumber, x0, x1, cast(coalesce(min_by(label, d + label * 1e-12) filter (d <= 1), -1) as int) as label from q group by rid, l_orderkey, l_linenumber, x0, x1)"""


@query(f"with {FINAL} select l_orderkey, l_linenumber, x0 || ' ' || x1 || ' ' || label as line from final")
def label_lines(spark, sf_dir):
    rows = model_of(spark, sf_dir).transform(planted(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", src.label_line(COLS).alias("line"))


# --- projections and predicates ----------------------------------------------------------


@query(f"with p as ({POINTS}) select l_orderkey, l_linenumber, x0, x1 from p where x0 <= 349")
def split_left(spark, sf_dir):
    return planted(spark, sf_dir).where(F.col("x0") <= 349).select("l_orderkey", "l_linenumber", *COLS)


@query(f"with p as ({POINTS}) select l_orderkey, l_linenumber, x0, x1 from p where x0 > 349")
def split_right(spark, sf_dir):
    return planted(spark, sf_dir).where(F.col("x0") > 349).select("l_orderkey", "l_linenumber", *COLS)


@query(f"""with p as ({POINTS}), g as (select {GROUP} as grp, {SUMS} from p group by 1), k as (select grp, row_number() over (order by ls0 / cast(n as double), ls1 / cast(n as double)) - 1 as block from g)
select l_orderkey, l_linenumber, x0, x1, cast(block as int) as block from p join k on {GROUP} = k.grp""")
def block_assignment(spark, sf_dir):
    model, rows = model_of(spark, sf_dir), planted(spark, sf_dir)
    order = sorted(model.leaves, key=lambda b: b.summary.centroid)
    block = block_column(model.blocks, COLS)
    rank = F.coalesce(*[F.when(block == b.id, i) for i, b in enumerate(order)])
    return rows.select("l_orderkey", "l_linenumber", *COLS, rank.cast("int").alias("block"))


@query(f"with p as ({POINTS}) select l_orderkey, l_linenumber, x0, x1 from p where x0 between {BOX[0][0]} and {BOX[1][0]} and x1 between {BOX[0][1]} and {BOX[1][1]}")
def box_filter(spark, sf_dir):
    return planted(spark, sf_dir).where(geometry.inside(COLS, *BOX)).select("l_orderkey", "l_linenumber", *COLS)


@query(f"with p as ({POINTS}) select count(*) as n from p where x0 between {BOX[0][0]} and {BOX[1][0]} and x1 between {BOX[0][1]} and {BOX[1][1]}")
def range_count(spark, sf_dir):
    return stats.count_inside(planted(spark, sf_dir), COLS, *BOX)


BOXES = f"with p as ({POINTS}), b as (select {GROUP} as grp, min(x0) as inf0, max(x0) as sup0, min(x1) as inf1, max(x1) as sup1, {SUMS} from p group by 1)"


def boxes(spark, sf_dir):
    rows = planted(spark, sf_dir).withColumn("grp", F.expr(GROUP))
    return rows.groupBy("grp").agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(COLS) for f, k in ((F.min, "inf"), (F.max, "sup"))], *stats.sums(COLS, wide=False))


@query(BOXES + f" select grp, {BOX[0][0]} <= inf0 and sup0 <= {BOX[1][0]} and {BOX[0][1]} <= inf1 and sup1 <= {BOX[1][1]} as held from b")
def box_contains_box(spark, sf_dir):
    held = geometry.holds_box(*BOX, [F.col("inf0"), F.col("inf1")], [F.col("sup0"), F.col("sup1")])
    return boxes(spark, sf_dir).select("grp", held.alias("held"))


_W = "greatest(1, cast(trunc((sup{0} - inf{0} + 1) * 0.1::double + 0.5::double) as int))"
_RS = "least(sup{0}, cast(trunc(ls{0} / cast(n as double) + " + _W + ") as int))"
_RI = "greatest(inf{0}, cast(trunc(ls{0} / cast(n as double) - " + _W + ") as int))"
RESTRICTED = BOXES + ", r as (select *, " + ", ".join(f"{_RI.format(i)} as a{i}, {_RS.format(i)} as b{i}" for i in (0, 1)) + ", n / (cast(sup0 - inf0 + 1 as double) * cast(sup1 - inf1 + 1 as double)) as density from b)"


def restricted(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    for i in (0, 1):
        low, high = geometry.restricted_bounds(F.col(f"ls{i}") / F.col("n"), F.col(f"inf{i}"), F.col(f"sup{i}"))
        rows = rows.withColumns({f"a{i}": low, f"b{i}": high})
    return rows.withColumn("density", F.col("n") / geometry.box_volume([F.col("inf0"), F.col("inf1")], [F.col("sup0"), F.col("sup1")]))


@query(RESTRICTED + " select grp, a0, b0, a1, b1 from r")
def restricted_boxes(spark, sf_dir):
    return restricted(spark, sf_dir).select("grp", "a0", "b0", "a1", "b1")


# --- assignments -------------------------------------------------------------------------


@query(f"with {LABELLED} select l_orderkey, l_linenumber, x0, x1, grp from near")
def intermediate_assignment(spark, sf_dir):
    model, rows = model_of(spark, sf_dir), planted(spark, sf_dir)
    names = rows.withColumn("_b", block_column(model.blocks, COLS)).groupBy("_b").agg(F.min(F.expr(GROUP)).alias("grp"))
    found = Clusterer(COLS, model.options).assign(rows, model.blocks, model.leaves, "_a")
    # inline keeps the null filter above the distances, which would be generated twice below it
    found = found.select("*", F.inline(F.array(F.struct(F.col("_a").alias("_b"))))).where("_b is not null")
    return found.join(F.broadcast(names), "_b").select("l_orderkey", "l_linenumber", *COLS, "grp")


@query(f"with {FINAL} select l_orderkey, l_linenumber, x0, x1, label from final")
def final_labels(spark, sf_dir):
    return model_of(spark, sf_dir).transform(planted(spark, sf_dir)).select("l_orderkey", "l_linenumber", *COLS, "label")


REACH = BOXES + f""", m as (select grp, ls0 / cast(n as double) as c0, ls1 / cast(n as double) as c1, 3.0::double * sqrt({SSQ.format(0)} / n) as r0, 3.0::double * sqrt({SSQ.format(1)} / n) as r1 from b)
select b.grp as block, m.grp as cluster from b, m where b.grp = m.grp or
  ((c0 - least(greatest(c0, inf0), sup0)) / r0) * ((c0 - least(greatest(c0, inf0), sup0)) / r0) + ((c1 - least(greatest(c1, inf1), sup1)) / r1) * ((c1 - least(greatest(c1, inf1), sup1)) / r1) <= 1"""


@query(REACH)
def reachability(spark, sf_dir):
    blocks, names = [], {}
    for i, r in enumerate(boxes(spark, sf_dir).collect()):
        names[i] = r["grp"]
        blocks.append(block_of(r, i))
    reach = refine.reachability(blocks)
    return frame(spark, [(names[i], names[j]) for i, s in reach.items() for j in s], "block string, cluster string")


# --- aggregations ------------------------------------------------------------------------


@query(f"with p as ({POINTS}) select min(x0) as inf0, max(x0) as sup0, min(x1) as inf1, max(x1) as sup1 from p")
def domain(spark, sf_dir):
    return stats.domain(planted(spark, sf_dir), COLS)


@query(f"with p as ({POINTS}), s as (select {SUMS} from p) select n, ls0, ls1, ss0, ss1, {SSQ.format(0)} as ssq0, {SSQ.format(1)} as ssq1, {SSQ.format(0)} + {SSQ.format(1)} as ssq from s")
def root_summary(spark, sf_dir):
    return stats.summaries(planted(spark, sf_dir), COLS).select("n", *[F.col(c).cast("bigint").alias(c) for c in ("ls0", "ls1", "ss0", "ss1")], *stats.ssq_columns(2))


_M = ", ".join(f"{BIG.format(f'cast(x{i} as bigint)')} as s{i}" for i in (0, 1)) + ", " + ", ".join(f"{BIG.format(f'cast(x{i} as bigint) * x{i}')} as q{i}" for i in (0, 1))
STATUS = "cast(case l_linestatus when 'F' then 0 else 1 end as int)"
MARGINALS = f"""p as ({POINTS}), m as (
  select {STATUS} as block, 0 as dim, x0 as pos, count(*) as cnt, {_M} from p group by 1, 2, 3
  union all select {STATUS}, 1, x1, count(*), {_M} from p group by 1, 2, 3)"""


def two_blocks(spark, sf_dir):
    rows = planted(spark, sf_dir).withColumn("block", F.when(F.col("l_linestatus") == "F", 0).otherwise(1))
    return stats.marginals(rows, COLS, "block")


@query(f"with {MARGINALS} select * from m")
def marginals(spark, sf_dir):
    return two_blocks(spark, sf_dir)


@query(f"with {MARGINALS} select 0 as block, dim, pos, cast(sum(cnt) as bigint) as cnt, cast(sum(s0) as bigint) as s0, cast(sum(s1) as bigint) as s1, cast(sum(q0) as bigint) as q0, cast(sum(q1) as bigint) as q1 from m group by dim, pos")
def marginal_merge(spark, sf_dir):
    m = two_blocks(spark, sf_dir).withColumn("part", F.col("block")).withColumn("block", F.lit(0))
    return stats.marginal_combine(m.where("part = 0").drop("part"), m.where("part = 1").drop("part"))


_TIMES = ", ".join(f"cast(sum({c} * case block when 0 then 1 else 3 end) as bigint) as {c}" for c in ("cnt", "s0", "s1", "q0", "q1"))


def one_block(m, block):
    return m.where(F.col("block") == block).withColumn("block", F.lit(0))


@query(f"with {MARGINALS} select 0 as block, dim, pos, {_TIMES} from m group by dim, pos")
def marginal_weighted_add(spark, sf_dir):
    m = two_blocks(spark, sf_dir)
    return stats.marginal_combine(one_block(m, 0), one_block(m, 1), 3)


@query(f"with {MARGINALS} select * from m where block = 0")
def marginal_retract(spark, sf_dir):
    return stats.marginal_combine(stats.marginals(planted(spark, sf_dir), COLS), one_block(two_blocks(spark, sf_dir), 1), -1)


@query(f"with {MARGINALS} select * from m where pos between 100 and 400")
def marginal_slice(spark, sf_dir):
    return stats.marginal_slice(two_blocks(spark, sf_dir), 100, 400)


@query(f"with {MARGINALS} select block, dim, cast(sum(cnt) as double) / (max(pos) - min(pos) + 1) as average from m group by block, dim")
def marginal_average(spark, sf_dir):
    return stats.marginal_average(two_blocks(spark, sf_dir))


@query(f"with {REFINED} select label, n, c0, c1, d0, d1, radius, ssq from f")
def cluster_profile(spark, sf_dir):
    rows = [(i, s.n, *s.centroid, *s.radii, s.radius, s.ssq) for i, s in enumerate(model_of(spark, sf_dir).refined)]
    return frame(spark, rows, "label bigint, n bigint, c0 double, c1 double, d0 double, d1 double, radius double, ssq double")


@query(f"with {REFINED} select label, n, ls0, ls1, ss0, ss1 from f")
def intermediate_summary(spark, sf_dir):
    rows = [(i, s.n, *s.ls, *s.ss) for i, s in enumerate(model_of(spark, sf_dir).refined)]
    return frame(spark, rows, "label bigint, n bigint, ls0 bigint, ls1 bigint, ss0 bigint, ss1 bigint")


@query(RESTRICTED + " select grp, n, density from r")
def block_density(spark, sf_dir):
    return restricted(spark, sf_dir).select("grp", "n", "density")


@query(RESTRICTED + """, o as (select density, lead(density) over (order by density) / density as v, row_number() over (order by density) as k from r),
t as (select coalesce(avg(v) + stddev_pop(v), 0) as lim from o)
select round(lim, 6) as lim, (select density from o where k = coalesce((select min(k) from o, t where v > lim), (select max(k) from o))) as threshold from t""")
def density_threshold(spark, sf_dir):
    return stats.jump_threshold(restricted(spark, sf_dir), "density").select(F.round("lim", 6).alias("lim"), "threshold")


@query("""with c as (select p_size, count(*) as n from part group by 1), o as (select n, lead(n) over (order by n, p_size) / cast(n as double) as v, row_number() over (order by n, p_size) as k from c),
t as (select avg(v) + stddev_pop(v) as lim from o)
select (select n from o where k = coalesce((select min(k) from o, t where v > lim), (select max(k) from o))) as threshold""")
def noise_threshold(spark, sf_dir):
    return stats.jump_threshold(size_counts(spark, sf_dir), "n").select("threshold")


def size_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))


@query("""with c as (select p_size, count(*) as n from part group by 1), e as (select n, row_number() over (order by n, p_size) - 1 as i from c), s as (select * from e where i between 5 and 30),
o as (select n, lead(n) over (order by i) / cast(n as double) as v, row_number() over (order by i) as k from s), t as (select avg(v) + stddev_pop(v) as lim from o)
select (select n from o where k = coalesce((select min(k) from o, t where v > lim), (select max(k) from o))) as threshold""")
def noise_threshold_slice(spark, sf_dir):
    return stats.jump_threshold(size_counts(spark, sf_dir), "n", 5, 30).select("threshold")


@query(RESTRICTED + f""", h as (select r.grp, count(*) as held from r join p on {GROUP.replace("l_", "p.l_")} = r.grp and x0 between a0 and b0 and x1 between a1 and b1 group by 1)
select r.grp, coalesce(held, 0) as held, coalesce(held, 0) >= 10 and coalesce(held, 0) / (cast(b0 - a0 + 1 as double) * cast(b1 - a1 + 1 as double)) >= 2 * density as high from r left join h on r.grp = h.grp""")
def restricted_density(spark, sf_dir):
    rows = planted(spark, sf_dir).withColumn("grp", F.expr(GROUP)).join(F.broadcast(restricted(spark, sf_dir)), "grp")
    inside = F.col("x0").between(F.col("a0"), F.col("b0")) & F.col("x1").between(F.col("a1"), F.col("b1"))
    got = rows.groupBy("grp", "a0", "b0", "a1", "b1", "density").agg(F.sum(F.when(inside, 1).otherwise(0)).cast("bigint").alias("held"))
    dense = F.col("held") / geometry.box_volume([F.col("a0"), F.col("a1")], [F.col("b0"), F.col("b1")])
    return got.select("grp", "held", ((F.col("held") >= 10) & (dense >= 2 * F.col("density"))).alias("high"))


@query(f"""with {REFINED}, w as (select cast(sum(n) as bigint) as n, count(*) as k, cast(sum(ls0) as bigint) as ls0, cast(sum(ls1) as bigint) as ls1, cast(sum(ss0) as bigint) as ss0, cast(sum(ss1) as bigint) as ss1, sum(ssq) as within from f)
select n, k, round(within, 3) as within, round((cast(n::hugeint * (ss0 + ss1) - ls0::hugeint * ls0 - ls1::hugeint * ls1 as double) / n) - within, 3) as between_, round((((cast(n::hugeint * (ss0 + ss1) - ls0::hugeint * ls0 - ls1::hugeint * ls1 as double) / n) - within) * (n - k)) / (within * (k - 1)), 3) as ch from w""")
def ch_index(spark, sf_dir):
    got = model_of(spark, sf_dir).refined
    whole = got[0]
    for s in got[1:]:
        whole = whole.plus(s)
    within = sum(s.ssq for s in got)
    between = whole.ssq - within
    ch = exact.calinski_harabasz(between, within, whole.n, len(got))
    return frame(spark, [(whole.n, len(got), round(within, 3), round(between, 3), round(ch, 3))], "n bigint, k bigint, within double, between_ double, ch double")


# --- windows -----------------------------------------------------------------------------

_UP = "over (partition by block, dim order by pos rows between unbounded preceding and current row)"
_ALL = "over (partition by block, dim)"
CUMULATIVE = f"""{MARGINALS}, c as (select block, dim, pos, cast(sum(cnt) {_UP} as bigint) as n1, cast(sum(s0) {_UP} as bigint) as l0, cast(sum(s1) {_UP} as bigint) as l1, cast(sum(q0) {_UP} as bigint) as r0, cast(sum(q1) {_UP} as bigint) as r1,
  cast(sum(cnt) {_ALL} as bigint) as n, cast(sum(s0) {_ALL} as bigint) as t0, cast(sum(s1) {_ALL} as bigint) as t1, cast(sum(q0) {_ALL} as bigint) as u0, cast(sum(q1) {_ALL} as bigint) as u1 from m)"""
_D = "(l{0} / cast(n1 as double) - (t{0} - l{0}) / cast(n - n1 as double))"
CANDIDATES = f"{CUMULATIVE}, d as (select block, dim, pos, n1, n, cast(n1 as double) * cast(n - n1 as double) / n * ({_D.format(0)} * {_D.format(0)} + {_D.format(1)} * {_D.format(1)}) as delta from c where n > n1)"


@query(f"with {CUMULATIVE} select * from c")
def cumulative_marginals(spark, sf_dir):
    return stats.cumulative(two_blocks(spark, sf_dir), 2)


@query(f"with {CANDIDATES} select * from d")
def split_candidates(spark, sf_dir):
    return stats.split_candidates(stats.cumulative(two_blocks(spark, sf_dir), 2), 2).select("block", "dim", "pos", "n1", "n", "delta")


@query(f"with {CANDIDATES.replace(STATUS, '0')} select dim, pos, n1, delta from d order by delta desc, dim desc, pos limit 1")
def best_split(spark, sf_dir):
    """As ``fit`` seeks it: only in ranges of positions that can hold the best cut."""
    rows = planted(spark, sf_dir)
    root = Clusterer(COLS).root(rows)
    found = stats.bounded_splits(stats.marginals(rows, COLS), 2, root.inf, stats.part_shifts(root.inf, root.sup))
    return found.select("dim", "pos", "n1", "delta")


AVERAGE = f"""{MARGINALS}, e as (select block, dim, min(pos) as lo, max(pos) as hi from m group by 1, 2), g as (select block, dim, lo, hi, unnest(generate_series(lo, hi)) as pos from e),
v as (select g.block, g.dim, g.pos, hi - lo + 1 as w, (hi - lo + 1) // 20 as s, pos - lo as j, coalesce(m.cnt, 0) as cnt from g left join m using (block, dim, pos)),
a as (select a.block, a.dim, a.pos, a.cnt, cast(sum(b.cnt) as double) / count(*) as avg from v a join v b on a.block = b.block and a.dim = b.dim and b.j between greatest(0, a.j - a.s) and least(a.w - 1, a.j + a.s - 1) group by 1, 2, 3, 4)"""


def stretches(spark, sf_dir):
    """As the valley test of ``fit`` works: where the window of each histogram holds the same points."""
    m = two_blocks(spark, sf_dir)
    boxes = m.groupBy("block", "dim").agg(F.min("pos").cast("bigint").alias("low"), (F.max("pos") - F.min("pos") + 1).cast("bigint").alias("width"), F.sum("cnt").alias("n"), F.lit(False).alias("is_root"))
    return m, valley.stretches(m.select("block", "dim", "pos", F.col("cnt").alias("n")), boxes)


@query(f"with {AVERAGE} select block, dim, cast(pos as int) as pos, cnt, avg from a")
def mobile_average(spark, sf_dir):
    m, rows = stretches(spark, sf_dir)
    keys = ["block", "dim", "pos"]
    return valley.moving_average(rows).join(m.select(*keys, "cnt"), keys, "left").select(*keys, F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"), "avg")


@query(f"""with {AVERAGE}, x as (select *, lag(avg) over (partition by block, dim order by pos) as before, lead(avg) over (partition by block, dim order by pos) as after from a)
select block, dim, cast(pos as int) as pos, avg, avg > before and avg > after as is_max from x where (avg > before and avg > after) or (avg < before and avg < after)""")
def local_extrema(spark, sf_dir):
    return valley.local_extrema(stretches(spark, sf_dir)[1])


NUMBER = "cast(1 + case l_returnflag when 'A' then 0 when 'N' then 2 else 4 end + case l_linestatus when 'F' then 0 else 1 end as int)"
# the whole is block 0; beyond the ends of a histogram lies nothing, so one neighbour decides there
VALLEY = f"""with p as ({POINTS}), q as (select 0 as block, x0, x1 from p union all select {NUMBER}, x0, x1 from p),
m as (select block, 0 as dim, x0 as pos, count(*) as cnt from q group by all union all select block, 1, x1, count(*) from q group by all),
e as (select block, dim, min(pos) as lo, max(pos) as hi, sum(cnt) as n from m group by 1, 2), g as (select block, dim, lo, hi, unnest(generate_series(lo, hi)) as pos from e),
v as (select g.block, g.dim, hi - lo + 1 as w, (hi - lo + 1) // 20 as s, pos - lo as j, coalesce(m.cnt, 0) as cnt from g left join m using (block, dim, pos)),
a as (select a.block, a.dim, a.j, cast(sum(b.cnt) as double) / count(*) as m from v a join v b on a.block = b.block and a.dim = b.dim and b.j between greatest(0, a.j - a.s) and least(a.w - 1, a.j + a.s - 1) group by 1, 2, 3),
t as (select a.block, a.dim, 0.1 * avg(m) as share, max(m) as top, any_value(e.block > 0 and (select max(m) from a b where b.block = e.block and b.dim = e.dim) < e.n / (hi - lo + 1) or (hi - lo + 1) // 20 < 2) as flat from a join e using (block, dim) group by 1, 2),
x as (select *, lag(m) over o as before, lead(m) over o as after from a window o as (partition by block, dim order by j)),
c as (select x.*, greatest(1, share) as gap, flat, (before is null or m > before) and (after is null or m > after) and m >= share as high, m < before and (after is null or m < after) and m <= top - share as low from x join t using (block, dim)),
r as (select *, max(m) filter (high) over (partition by block, dim order by j rows between unbounded preceding and 1 preceding) as l, max(m) filter (high) over (partition by block, dim order by j rows between 1 following and unbounded following) as r from c),
d as (select block, dim, not any_value(flat) and coalesce(bool_or(low and m <= l - gap and r >= m + gap), false) as found, not any_value(flat) and coalesce(bool_or(low and m <= l - gap), false) and coalesce(bool_or(low and l is not null and r is not null), false) as falls from r group by 1, 2)
select cast(e.n as bigint) as n, a.found or (a.falls and b.found) as valley from d a join d b on a.block = b.block and a.dim = 0 and b.dim = 1 join e on e.block = a.block and e.dim = 0"""


@query(VALLEY)
def valley_flag(spark, sf_dir):
    """Whether the histograms of the whole and of each planted group (in its own box) have a valley."""
    rows = planted(spark, sf_dir).withColumn("block", F.explode(F.array(F.lit(0), F.expr(NUMBER))))
    bounds = stats.domain(rows, COLS, ["block"]).join(stats.summaries(rows, COLS, ["block"]), "block").collect()
    tree = {r["block"]: block_of(r, r["block"]) for r in bounds}
    work = Clusterer(COLS)
    work.valleys(stats.marginals(rows, COLS, "block"), tree, list(tree))
    return frame(spark, [(b.summary.n, work.valley(tree, i)) for i, b in tree.items()], "n bigint, valley boolean")


def block_of(r, i: int) -> refine.Block:
    """A block from a row of bounds and sums."""
    return refine.Block(i, refine.Summary(r["n"], (int(r["ls0"]), int(r["ls1"])), (int(r["ss0"]), int(r["ss1"]))), (r["inf0"], r["inf1"]), (r["sup0"], r["sup1"]))


# --- divisive, agglomerative, whole runs -------------------------------------------------

def _dev(i: int | None = None) -> str:
    """SQL for the sum of squared deviations of one dimension or both, from exact sums."""
    square, sums = (f"ss{i}", f"ls{i}::hugeint * ls{i}") if i is not None else ("(ss0 + ss1)", "ls0::hugeint * ls0 - ls1::hugeint * ls1")
    return f"(cast(n::hugeint * {square} - {sums} as double) / n)"


_UP_DIM, _ALL_DIM = _UP.replace("block, ", ""), _ALL.replace("block, ", "")
# one turn of the recursion takes the open block of largest deviation: its cut, its valley test, and either two new blocks or a leaf
TRACE = f"""with recursive p as (select x0, x1 from ({POINTS})),
z as (select count(*) as n, sum(x0) as ls0, sum(x1) as ls1, sum(x0 * x0) as ss0, sum(x1 * x1) as ss1, min(x0) as lo0, max(x0) as hi0, min(x1) as lo1, max(x1) as hi1 from p),
r as (
  select 0 as step, 0 as id, lo0, hi0, lo1, hi1, cast(n as bigint) as n, {_dev()} as ssq, true as is_open, 1 as k, 0.0::double as best, {_dev()} as within, 0.0::double as between_, cast(n as bigint) as big_n, 1 as next_id,
    0 as block, 0 as dim, 0 as pos, 0::bigint as n1, 0.0::double as delta, 0.0::double as ch, false as accepted, '' as by_ from z
  union all
  select step, u.id, u.lo0, u.hi0, u.lo1, u.hi1, u.n, u.ssq, u.is_open, k, best, within, between_, big_n, next_id, block, dim, pos, n1, delta, ch, accepted, by_ from (
    with b as (select * from r where is_open order by ssq desc, id limit 1),
    o as (select p.x0, p.x1 from p, b where p.x0 between lo0 and hi0 and p.x1 between lo1 and hi1),
    m as (select 0 as dim, x0 as pos, count(*) as cnt, sum(x0) as s0, sum(x1) as s1, sum(x0 * x0) as q0, sum(x1 * x1) as q1 from o group by x0 union all select 1, x1, count(*), sum(x0), sum(x1), sum(x0 * x0), sum(x1 * x1) from o group by x1),
    c as (select dim, pos, cast(sum(cnt) {_UP_DIM} as bigint) as n1, cast(sum(s0) {_UP_DIM} as bigint) as l0, cast(sum(s1) {_UP_DIM} as bigint) as l1, cast(sum(q0) {_UP_DIM} as bigint) as r0, cast(sum(q1) {_UP_DIM} as bigint) as r1,
      cast(sum(cnt) {_ALL_DIM} as bigint) as n, cast(sum(s0) {_ALL_DIM} as bigint) as t0, cast(sum(s1) {_ALL_DIM} as bigint) as t1, cast(sum(q0) {_ALL_DIM} as bigint) as u0, cast(sum(q1) {_ALL_DIM} as bigint) as u1 from m),
    d as (select *, cast(n1 as double) * cast(n - n1 as double) / n * ({_D.format(0)} * {_D.format(0)} + {_D.format(1)} * {_D.format(1)}) as delta from c where n > n1 order by delta desc, dim desc, pos limit 1),
    e as (select 0 as dim, lo0 as lo, hi0 as hi from b union all select 1, lo1, hi1 from b),
    g as (select dim, lo, hi, unnest(generate_series(lo, hi)) as pos from e),
    v as (select g.dim, hi - lo + 1 as w, (hi - lo + 1) // 20 as s, g.pos - lo as j, coalesce(m.cnt, 0) as cnt from g left join m on g.dim = m.dim and g.pos = m.pos),
    a as (select a.dim, a.j, a.w, a.s, cast(sum(b.cnt) as double) / count(*) as m from v a join v b on a.dim = b.dim and b.j between greatest(0, a.j - a.s) and least(a.w - 1, a.j + a.s - 1) group by all),
    t as (select dim, 0.1 * avg(m) as share, max(m) as top, any_value(s) < 2 or (select id > 0 from b) and max(m) < (select n from b) / any_value(w) as flat from a group by dim),
    x as (select *, lag(m) over (partition by dim order by j) as before, lead(m) over (partition by dim order by j) as after from a),
    h as (select x.dim, j, m, greatest(1, share) as gap, flat, (before is null or m > before) and (after is null or m > after) and m >= share as high, m < before and (after is null or m < after) and m <= top - share as low from x join t using (dim)),
    y as (select *, max(m) filter (high) over (partition by dim order by j rows between unbounded preceding and 1 preceding) as l, max(m) filter (high) over (partition by dim order by j rows between 1 following and unbounded following) as r from h),
    f as (select dim, not any_value(flat) and coalesce(bool_or(low and m <= l - gap and r >= m + gap), false) as found, not any_value(flat) and coalesce(bool_or(low and m <= l - gap), false) and coalesce(bool_or(low and l is not null and r is not null), false) as falls from y group by dim),
    w as (select bool_or(dim = 0 and found) or (bool_or(dim = 0 and falls) and bool_or(dim = 1 and found)) as valley from f),
    i as (select b.*, d.dim as cut_dim, d.pos as cut_pos, d.n1 as cut_n1, d.delta as gain, l0, l1, r0, r1, t0, t1, u0, u1, (between_ + d.delta) * (big_n - (k + 1)) / ((within - d.delta) * k) as index_ from b, d),
    k2 as (select i.*, k > 1 and index_ >= best as by_index, index_ >= 0.7 * best and (select valley from w) as by_valley from i),
    j as (select *, by_index or by_valley as ok, case when by_index then 'index' when by_valley then 'valley' else 'none' end as how,
      (cast(cut_n1::hugeint * (r0 + r1) - l0::hugeint * l0 - l1::hugeint * l1 as double) / cut_n1) as left_ssq,
      (cast((n - cut_n1)::hugeint * (u0 - r0 + u1 - r1) - (t0 - l0)::hugeint * (t0 - l0) - (t1 - l1)::hugeint * (t1 - l1) as double) / (n - cut_n1)) as right_ssq from k2)
    select j.step + 1 as step, u, case when ok then j.k + 1 else j.k end as k, case when ok then greatest(j.best, index_) else j.best end as best, case when ok then j.within - gain else j.within end as within, case when ok then j.between_ + gain else j.between_ end as between_,
      j.big_n, case when ok then j.next_id + 2 else j.next_id end as next_id, j.id as block, cut_dim as dim, cut_pos as pos, cut_n1 as n1, gain as delta, index_ as ch, ok as accepted, how as by_
    from j, (select r.id as old, {{'id': r.id, 'lo0': r.lo0, 'hi0': r.hi0, 'lo1': r.lo1, 'hi1': r.hi1, 'n': r.n, 'ssq': r.ssq, 'is_open': r.is_open and (ok or r.id <> j.id)}} as u from r, j where not ok or r.id <> j.id
      union all select -1, {{'id': next_id, 'lo0': lo0, 'hi0': if(cut_dim = 0, cut_pos, hi0), 'lo1': lo1, 'hi1': if(cut_dim = 1, cut_pos, hi1), 'n': cut_n1, 'ssq': left_ssq, 'is_open': left_ssq > 0}} from j where ok
      union all select -1, {{'id': next_id + 1, 'lo0': if(cut_dim = 0, cut_pos + 1, lo0), 'hi0': hi0, 'lo1': if(cut_dim = 1, cut_pos + 1, lo1), 'hi1': hi1, 'n': n - cut_n1, 'ssq': right_ssq, 'is_open': right_ssq > 0}} from j where ok) l))
select distinct cast(step - 1 as int) as step, cast(block as int) as block, cast(dim as int) as dim, cast(pos as int) as pos, n1, round(delta, 3) as delta, round(ch, 3) as ch, accepted, by_ as reason from r where step > 0"""


@query(TRACE)
def divisive_trace(spark, sf_dir):
    """Every block as the best-first queue gave it out, its best cut, and whether and why it was cut."""
    rows = [(i, t["block"], t["dim"], t["pos"], t["n1"], round(t["delta"], 3), round(t["index"], 3), t["accepted"], t["by"]) for i, t in enumerate(model_of(spark, sf_dir).trace)]
    return frame(spark, rows, "step int, block int, dim int, pos int, n1 bigint, delta double, ch double, accepted boolean, reason string")


@query(f"with p as ({POINTS}), g as (select {SUMS} from p group by {GROUP}) select n, ls0, ls1, ss0, ss1 from g")
def divisive_blocks(spark, sf_dir):
    rows = [(b.summary.n, *b.summary.ls, *b.summary.ss) for b in model_of(spark, sf_dir).leaves]
    return frame(spark, rows, "n bigint, ls0 bigint, ls1 bigint, ss0 bigint, ss1 bigint")


PAIRS = f"""with {REFINED}, j as (select a.label as a, b.label as b, a.n as n1, b.n as n2, a.radius + b.radius as reach, a.c0 - b.c0 as e0, a.c1 - b.c1 as e1, a.n + b.n as n, a.ls0 + b.ls0 as ls0, a.ls1 + b.ls1 as ls1, a.ss0 + b.ss0 as ss0, a.ss1 + b.ss1 as ss1 from f a join f b on a.label < b.label)
select a, b, round(cast(n1 * n2 as double) / n * (e0 * e0 + e1 * e1), 3) as cost, sqrt({SSQ.format(0)} / n) <= 2 * reach and sqrt({SSQ.format(1)} / n) <= 2 * reach as admissible from j"""


@query(PAIRS)
def merge_pairs(spark, sf_dir):
    rows = [(a.id, b.id, round(refine.merge_cost(a, b), 3), refine.admissible(a, b)) for a, b in combinations(model_of(spark, sf_dir).refined, 2)]
    return frame(spark, rows, "a bigint, b bigint, cost double, admissible boolean")


def parts(spark, sf_dir):
    """Summaries of the planted groups, each cut by line number: 42 or fewer that lie upon six centres."""
    rows = planted(spark, sf_dir).withColumn("grp", F.concat(F.expr(GROUP), F.col("l_linenumber").cast("string")))
    got = sorted(stats.summaries(rows, COLS, ["grp"]).collect(), key=lambda r: r["grp"])
    return [refine.Summary(r["n"], (int(r["ls0"]), int(r["ls1"])), (int(r["ss0"]), int(r["ss1"])), i) for i, r in enumerate(got)]


# one turn of the recursion merges the cheapest admissible pair of the summaries that are left
SEQUENCE = f"""with recursive p as ({POINTS}), s as (select {GROUP} || l_linenumber as grp, {SUMS} from p group by 1),
t as (select count(*) as k, sum(n) as big_n, sum({_dev()}) as within, (cast(sum(n)::hugeint * (sum(ss0) + sum(ss1)) - sum(ls0)::hugeint * sum(ls0) - sum(ls1)::hugeint * sum(ls1) as double) / sum(n)) - sum({_dev()}) as between_ from s),
r as (
  select 0 as step, row_number() over (order by grp) - 1 as id, n, ls0, ls1, ss0, ss1, k, big_n, within, between_, between_ * (big_n - k) / (within * (k - 1)) as highest, 0.0::double as ch, 0::bigint as i, 0::bigint as j, 0.0::double as cost from s, t
  union all
  select step, u.id, u.n, u.ls0, u.ls1, u.ss0, u.ss1, k, big_n, within, between_, greatest(highest, ch), ch, i, j, cost from (
    with a as (select *, ls0 / cast(n as double) as c0, ls1 / cast(n as double) as c1, sqrt({_dev()} / n) as radius from r),
    b as (select a.id as i, b.id as j, a.n * cast(b.n as double) / (a.n + b.n) * ((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1)) as cost, a.radius + b.radius as reach,
      a.n + b.n as n, a.ls0 + b.ls0 as ls0, a.ls1 + b.ls1 as ls1, a.ss0 + b.ss0 as ss0, a.ss1 + b.ss1 as ss1 from a join a b on a.id < b.id),
    c as (select * from b where sqrt({_dev(0)} / n) <= 2 * reach and sqrt({_dev(1)} / n) <= 2 * reach order by cost, i, j limit 1),
    d as (select any_value(step) as step, any_value(k) as k, any_value(big_n) as big_n, any_value(within) as within, any_value(between_) as between_, any_value(highest) as highest, max(id) as last from r),
    e as (select d.*, c.i, c.j, c.cost, c.n, c.ls0, c.ls1, c.ss0, c.ss1, (between_ - cost) * (big_n - (k - 1)) / ((within + cost) * (k - 2)) as ch from c, d where k > 2)
    select e.step + 1 as step, unnest([{{'id': l.id, 'n': l.n, 'ls0': l.ls0, 'ls1': l.ls1, 'ss0': l.ss0, 'ss1': l.ss1}}]) as u, e.k - 1 as k, e.big_n, e.within + cost as within, e.between_ - cost as between_, highest, ch, i, j, cost
    from e, (select id, n, ls0, ls1, ss0, ss1, false as is_new from r union all select last + 1, n, ls0, ls1, ss0, ss1, true from e) l
    where ch > 0.9 * highest and l.id <> e.i and l.id <> e.j)),
f as (select step, any_value(i) as i, any_value(j) as j, max(id) as made, max_by(n, id) as n, any_value(cost) as cost, any_value(ch) as ch, count(*) as clusters from r group by step),
top as (select min(step) as step from f where step > 0 and ch = (select max(ch) from f where step > 0) and ch > (select any_value(highest) from r where step = 0))
select cast(f.step as int) as step, cast(i as int) as a, cast(j as int) as b, cast(made as int) as made, n, round(cost, 3) as cost, round(ch, 3) as ch, cast(clusters as int) as clusters, f.step <= coalesce(top.step, 0) as kept from f, top where f.step > 0"""


@query(SEQUENCE)
def merge_sequence(spark, sf_dir):
    """All merges of the parts, cheapest first, and which are kept."""
    _, steps = refine.merge(parts(spark, sf_dir))
    rows = [(s["step"], s["left"], s["right"], s["made"].id, s["made"].n, round(s["cost"], 3), round(s["index"], 3), s["clusters"], s["kept"]) for s in steps]
    return frame(spark, rows, "step int, a int, b int, made int, n bigint, cost double, ch double, clusters int, kept boolean")


@query(f"with p as ({POINTS}), g as (select {SUMS} from p group by {GROUP}) select n, ls0, ls1, ss0, ss1 from g")
def merged_clusters(spark, sf_dir):
    """The parts merged: the planted groups again."""
    got, _ = refine.merge(parts(spark, sf_dir))
    return frame(spark, [(s.n, *s.ls, *s.ss) for s in got], "n bigint, ls0 bigint, ls1 bigint, ss0 bigint, ss1 bigint")


# the group RF thinned out and strewn over its part of the plane
IS_RF = "l_returnflag || l_linestatus = 'RF'"
STREWN = f"select l_returnflag, l_linestatus, case when {IS_RF} then cast(350 + l_orderkey * 37 % 390 as int) else x0 end as x0, case when {IS_RF} then cast(5 + l_partkey * 13 % 130 as int) else x1 end as x1 from (select *, {X0} as x0, {X1} as x1 from lineitem) where not ({IS_RF}) or l_orderkey % 200 = 0"


@query(f"with p as ({STREWN}), g as (select {GROUP} = 'RF' as is_outlier, {SUMS} from p group by {GROUP}) select n, ls0, ls1, ss0, ss1, is_outlier from g")
def outlier_blocks(spark, sf_dir):
    """The outlier rule over the boxes of the groups: the strewn one alone is sparse, in the middle as well."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("*", f"{X0} as x0", f"{X1} as x1").where(f"not ({IS_RF}) or l_orderkey % 200 = 0")
    rows = rows.selectExpr(f"{GROUP} as grp", f"case when {IS_RF} then cast(350 + l_orderkey * 37 % 390 as int) else x0 end as x0", f"case when {IS_RF} then cast(5 + l_partkey * 13 % 130 as int) else x1 end as x1")
    rows = rows.withColumn("block", F.expr(NUMBER.replace("l_returnflag", "substr(grp, 1, 1)").replace("l_linestatus", "substr(grp, 2, 1)")))
    bounds = stats.domain(rows, COLS, ["block"]).join(stats.summaries(rows, COLS, ["block"]), "block").collect()
    leaves = [block_of(r, r["block"]) for r in bounds]
    Clusterer(COLS).find_outliers(rows, leaves)
    out = [(b.summary.n, *b.summary.ls, *b.summary.ss, b.is_outlier) for b in leaves]
    return frame(spark, out, "n bigint, ls0 bigint, ls1 bigint, ss0 bigint, ss1 bigint, is_outlier boolean")


@query()
def run_metrics(spark, sf_dir):
    model = model_of(spark, sf_dir)
    rows = list({**model.metrics, "blocks_without_outliers": model.number_of_blocks}.items())
    return frame(spark, [(k, float(v)) for k, v in rows], "metric string, value double")


@query(f"with {FINAL} select label, count(*) as n, min(x0) as inf0, max(x0) as sup0, min(x1) as inf1, max(x1) as sup1 from final group by label")
def cluster_lineitem(spark, sf_dir):
    rows = model_of(spark, sf_dir).transform(planted(spark, sf_dir))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("inf0"), F.max("x0").alias("sup0"), F.min("x1").alias("inf1"), F.max("x1").alias("sup1"))


# --- functions ---------------------------------------------------------------------------


@query(f"with p as ({POINTS}) select l_orderkey, l_linenumber, ((250.0::double - x0) / 300.0::double) * ((250.0::double - x0) / 300.0::double) + ((120.0::double - x1) / 150.0::double) * ((120.0::double - x1) / 150.0::double) as d from p")
def elliptical_distance(spark, sf_dir):
    return planted(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.elliptical(COLS, [250.0, 120.0], [300.0, 150.0]).alias("d"))


@query(f"with p as ({POINTS}) select l_orderkey, l_linenumber, sqrt((x0 - 250.0::double) * (x0 - 250.0::double) + (x1 - 120.0::double) * (x1 - 120.0::double)) as d from p")
def euclidean_distance(spark, sf_dir):
    return planted(spark, sf_dir).select("l_orderkey", "l_linenumber", geometry.euclidean([F.col(c) for c in COLS], [F.lit(250.0), F.lit(120.0)]).alias("d"))


@query(BOXES + " select grp, cast(sup0 - inf0 + 1 as double) * cast(sup1 - inf1 + 1 as double) as volume from b")
def box_volume(spark, sf_dir):
    return boxes(spark, sf_dir).select("grp", geometry.box_volume([F.col("inf0"), F.col("inf1")], [F.col("sup0"), F.col("sup1")]).alias("volume"))


@query(f"with p as ({POINTS}) select l_orderkey, l_linenumber, 7 + cast(x0 as bigint) * x0 as y0, 11 + cast(x1 as bigint) * x1 as y1 from p")
def vector_add_square(spark, sf_dir):
    got = geometry.array_add_square(F.array(F.lit(7).cast("bigint"), F.lit(11).cast("bigint")), F.array(F.col("x0").cast("bigint"), F.col("x1").cast("bigint")))
    return planted(spark, sf_dir).select("l_orderkey", "l_linenumber", got.alias("y")).select("l_orderkey", "l_linenumber", F.col("y")[0].alias("y0"), F.col("y")[1].alias("y1"))


@query(f"""with p as ({POINTS}) select l_orderkey, l_linenumber, 7 + 2 * x0 as a0, 11 + 2 * x1 as a1, 7 + 3 * cast(x0 as bigint) * x0 as q0, 11 + 3 * cast(x1 as bigint) * x1 as q1, 5 * x0 as m0, 5 * x1 as m1,
  (x0 - 250.0::double) * (x0 - 250.0::double) + (x1 - 120.0::double) * (x1 - 120.0::double) as d from p""".replace("7 + 2 * x0", "cast(7 + 2 * x0 as bigint)").replace("11 + 2 * x1", "cast(11 + 2 * x1 as bigint)").replace("5 * x0", "cast(5 * x0 as bigint)").replace("5 * x1", "cast(5 * x1 as bigint)"))
def vector_arithmetic(spark, sf_dir):
    """Weighted add and add-square, multiply, and squared distance."""
    start, point = F.array(F.lit(7).cast("bigint"), F.lit(11).cast("bigint")), F.array(F.col("x0").cast("bigint"), F.col("x1").cast("bigint"))
    made = {"a": geometry.array_add(start, point, 2), "q": geometry.array_add_square(start, point, 3), "m": geometry.array_multiply(point, 5)}
    rows = planted(spark, sf_dir).withColumns({k: v for k, v in made.items()})
    d = geometry.squared_distance([F.col(c) for c in COLS], [F.lit(250.0), F.lit(120.0)])
    return rows.select("l_orderkey", "l_linenumber", *[F.col(k)[i].alias(f"{k}{i}") for k in made for i in (0, 1)], d.alias("d"))


@query(BOXES + " select grp, " + ", ".join(f"cast(sup{i} - inf{i} + 1 as bigint) as w{i}, (cast(inf{i} as double) + sup{i}) / 2 as c{i}" for i in (0, 1)) + " from b")
def box_shape(spark, sf_dir):
    made = [f(F.col(f"inf{i}"), F.col(f"sup{i}")).alias(f"{k}{i}") for i in (0, 1) for f, k in ((geometry.width, "w"), (geometry.middle, "c"))]
    return boxes(spark, sf_dir).select("grp", *made)


@query(BOXES + " select grp, true as held from b")
def random_inner_point(spark, sf_dir):
    """A random point of each box: inside it."""
    lows, highs = [F.col("inf0"), F.col("inf1")], [F.col("sup0"), F.col("sup1")]
    rows = boxes(spark, sf_dir).withColumns({f"r{i}": c for i, c in enumerate(geometry.random_point(lows, highs))})
    return rows.select("grp", (F.col("r0").between(F.col("inf0"), F.col("sup0")) & F.col("r1").between(F.col("inf1"), F.col("sup1"))).alias("held"))


@query("select cast(trunc(c_acctbal) as int) as x0, c_nationkey as x1, c_custkey from customer")
def points_of_dataframe(spark, sf_dir):
    return src.from_dataframe(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"]).select("x0", "x1", "c_custkey")
