"""Queries over the driver's tables, one or more for each operator family, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import verbena as v
from verbena import _, Fx
from verbena.table import Tbl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one scale, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> Tbl:
        return v.tbl(self._spark, f"{self._dir}/{name}.parquet")


def query(sql: str) -> Callable:
    def register(f: Callable[[Tables], Tbl]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir)).to_spark()
        SQL[f.__name__] = sql
        return f

    return register


def big(x):
    return x.astype("int")


# --- projection, filter, order ------------------------------------------------------------------------

@query("SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem WHERE l_quantity < 24 GROUP BY l_returnflag")
def flagship(t):
    return t.lineitem >> v.filter(_.l_quantity < 24) >> v.group_by(_.l_returnflag) >> v.summarize(n=v.n(_), avg_price=_.l_extendedprice.mean().round(4)) >> v.arrange(_.l_returnflag)


@query("SELECT c_name, c_custkey AS id, c_acctbal FROM customer")
def select_rename(t):
    return t.customer >> v.select(_.c_name, _.id == _.c_custkey, _.c_acctbal)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def select_range_and_drop(t):
    return t.orders >> v.select(_["o_orderkey":"o_orderpriority"], -_.o_custkey) >> v.select(-_.o_orderdate)


@query("SELECT l_extendedprice, l_discount, l_tax FROM lineitem")
def select_predicates(t):
    return t.lineitem >> v.select(_.contains("price|discount"), _.endswith("tax"))


@query("SELECT r_regionkey AS region_id, r_name FROM region")
def rename_columns(t):
    return t.region >> v.rename(region_id=_.r_regionkey)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross FROM lineitem")
def mutate_sequential(t):
    return t.lineitem >> v.mutate(net=_.l_extendedprice * (1 - _.l_discount), gross=_.net * (1 + _.l_tax)) >> v.transmute(_.l_orderkey, _.l_linenumber, net=_.net.round(6), gross=_.gross.round(7))


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS over_mean, max(o_totalprice) OVER (PARTITION BY o_orderpriority) AS top FROM orders")
def mutate_grouped_window(t):
    return t.orders >> v.group_by(_.o_orderpriority) >> v.mutate(over_mean=(_.o_totalprice - _.o_totalprice.mean()).round(2), top=_.o_totalprice.max()) >> v.ungroup() >> v.select(_.o_orderkey, _.over_mean, _.top)


@query("SELECT c_custkey, round(c_acctbal / (SELECT avg(c_acctbal) FROM customer), 6) AS share FROM customer")
def mutate_ungrouped_aggregate(t):
    return t.customer >> v.transmute(_.c_custkey, share=(_.c_acctbal / _.c_acctbal.mean()).round(6))


@query("SELECT l_returnflag, round(l_quantity * 2, 2) AS twice FROM lineitem WHERE l_linenumber = 1")
def transmute_grouped(t):
    return t.lineitem >> v.filter(_.l_linenumber == 1) >> v.group_by(_.l_returnflag) >> v.transmute(twice=(_.l_quantity * 2).round(2)) >> v.ungroup()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE l_quantity = m")
def filter_group_minimum(t):
    return t.lineitem >> v.group_by(_.l_orderkey) >> v.filter(_.l_quantity == _.l_quantity.min()) >> v.ungroup() >> v.select(_.l_orderkey, _.l_linenumber, _.l_quantity)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '1%'")
def filter_many(t):
    return t.orders >> v.filter(_.o_totalprice > 100000, _.o_orderstatus.isin(["F", "O"]), _.o_orderpriority.str.startswith("1")) >> v.select(_.o_orderkey, _.o_totalprice)


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def arrange_head(t):
    return t.part >> v.arrange(-_.p_retailprice, _.p_partkey) >> v.head(20) >> v.select(_.p_partkey, _.p_name)


@query("SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 7")
def arrange_tail(t):
    return t.part >> v.arrange(_.p_partkey) >> v.tail(7) >> v.select(_.p_partkey)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 2")
def top_n_grouped(t):
    return t.orders >> v.group_by(_.o_custkey) >> v.top_n(2, _.o_totalprice) >> v.ungroup() >> v.select(_.o_custkey, _.o_orderkey, _.o_totalprice)


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, rank() OVER (ORDER BY o_totalprice) AS r FROM orders) WHERE r <= 5")
def top_n_least(t):
    return t.orders >> v.top_n(-5, _.o_totalprice) >> v.select(_.o_orderkey, _.o_totalprice)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_pairs(t):
    return t.lineitem >> v.distinct(_.l_returnflag, _.l_linestatus)


@query("SELECT DISTINCT floor(p_size / 10)::BIGINT AS band FROM part")
def distinct_computed(t):
    return t.part >> v.distinct(band=big(_.p_size // 10))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_keep_all(t):
    return t.orders >> v.arrange(_.o_orderkey) >> v.distinct(_.o_custkey, _keep_all=True) >> v.select(_.o_custkey, _.o_orderkey)


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'rich' END AS kind, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END::BIGINT AS building FROM customer")
def case_when_if_else(t):
    return t.customer >> v.transmute(_.c_custkey, kind=v.case_when({_.c_acctbal < 0: "debt", _.c_acctbal < 5000: "mid", True: "rich"}), building=big(v.if_else(_.c_mktsegment == "BUILDING", 1, 0)))


@query("SELECT o_orderkey, length(o_orderpriority)::BIGINT AS len, o_totalprice * 2 AS dbl FROM orders")
def raw_sql(t):
    return t.orders >> v.transmute(_.o_orderkey, len=v.sql_raw("cast(length(o_orderpriority) as bigint)"), dbl=v.sql_raw("o_totalprice * 2"))


# --- across -------------------------------------------------------------------------------------------

@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity_mean, max(l_quantity) AS l_quantity_max, round(avg(l_discount), 6) AS l_discount_mean, max(l_discount) AS l_discount_max FROM lineitem GROUP BY l_returnflag")
def across_summarize(t):
    out = t.lineitem >> v.group_by(_.l_returnflag) >> v.summarize(v.across(_["l_quantity", "l_discount"], {"mean": Fx.mean(), "max": Fx.max()}))
    return out >> v.mutate(l_quantity_mean=_.l_quantity_mean.round(4), l_discount_mean=_.l_discount_mean.round(6))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 10 AS l_quantity, l_tax * 10 AS l_tax FROM lineitem")
def across_mutate(t):
    return t.lineitem >> v.mutate(v.across(_["l_quantity", "l_tax"], Fx * 10)) >> v.select(_.l_orderkey, _.l_linenumber, _.l_quantity, _.l_tax)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_extendedprice > 10")
def across_filter(t):
    return t.lineitem >> v.filter(v.across(_["l_quantity", "l_extendedprice"], Fx > 10)) >> v.select(_.l_orderkey, _.l_linenumber)


@query("SELECT upper(l_returnflag) AS l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def across_count(t):
    return t.lineitem >> v.count(v.across(_.l_returnflag, Fx.str.upper()))


# --- grouping -----------------------------------------------------------------------------------------

@query("SELECT o_orderpriority, year(o_orderdate)::BIGINT AS y, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def group_by_computed(t):
    return t.orders >> v.group_by(_.o_orderpriority) >> v.group_by(y=big(_.o_orderdate.dt.year), add=True) >> v.summarize(n=v.n(_), total=_.o_totalprice.sum().round(2))


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS va, median(l_quantity) AS med, round(quantile_cont(l_quantity, 0.9), 6) AS q9,
 count(DISTINCT l_suppkey)::BIGINT AS sup, min(l_shipdate) AS first_ship, round(corr(l_quantity, l_extendedprice), 6) AS cr, round(covar_samp(l_quantity, l_discount), 6) AS cv, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 8) AS se FROM lineitem GROUP BY 1""")
def aggregates(t):
    return t.lineitem >> v.group_by(_.l_returnflag) >> v.summarize(
        sd=_.l_quantity.std().round(6), va=_.l_quantity.var().round(6), med=_.l_quantity.median(), q9=_.l_quantity.quantile(0.9).round(6), sup=_.l_suppkey.nunique(), first_ship=_.l_shipdate.min(),
        cr=_.l_quantity.corr(_.l_extendedprice).round(6), cv=_.l_quantity.cov(_.l_discount).round(6), se=_.l_quantity.sem().round(8))


@query("SELECT l_linestatus, round(skewness(l_extendedprice), 6) AS sk, round(kurtosis(l_extendedprice), 6) AS ku, bool_and(l_quantity > 0) AS pos, bool_or(l_discount > 0.09) AS deep FROM lineitem GROUP BY 1")
def aggregate_shapes(t):
    return t.lineitem >> v.mutate(pos=_.l_quantity > 0, deep=_.l_discount > 0.09) >> v.group_by(_.l_linestatus) >> v.summarize(sk=_.l_extendedprice.skew().round(6), ku=_.l_extendedprice.kurt().round(6), pos=_.pos.all(), deep=_.deep.any())


@query("SELECT o_orderstatus, round(avg(abs(d)), 4) AS mad FROM (SELECT o_orderstatus, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS d FROM orders) GROUP BY 1")
def aggregate_of_window(t):
    return t.orders >> v.group_by(_.o_orderstatus) >> v.summarize(mad=_.o_totalprice.mad().round(4))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1")
def summarize_first_last(t):
    return t.orders >> v.group_by(_.o_custkey) >> v.summarize(first_price=v.first(_.o_totalprice, order_by=_.o_orderkey), last_price=v.last(_.o_totalprice, order_by=_.o_orderkey))


@query("SELECT count(*)::BIGINT AS n, round(sum(l_extendedprice), 0) AS total FROM lineitem")
def summarize_all(t):
    return t.lineitem >> v.summarize(n=_.l_orderkey.size, total=_.l_extendedprice.sum().round(0))


@query("SELECT l_shipyear, l_returnflag, count(*)::BIGINT AS n FROM (SELECT year(l_shipdate)::BIGINT AS l_shipyear, l_returnflag FROM lineitem) GROUP BY ALL")
def count_pairs(t):
    return t.lineitem >> v.group_by(l_shipyear=big(_.l_shipdate.dt.year)) >> v.count(_.l_returnflag, sort=True)


@query("SELECT l_returnflag, sum(l_quantity) AS n FROM lineitem GROUP BY 1")
def count_weighted(t):
    return t.lineitem >> v.count(_.l_returnflag, wt=_.l_quantity)


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey)::BIGINT AS n FROM orders")
def add_count_column(t):
    return t.orders >> v.add_count(_.o_custkey) >> v.select(_.o_orderkey, _.n)


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_levels(t):
    return t.lineitem >> v.cube(_.l_returnflag, _.l_linestatus, n=v.n(_))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_levels(t):
    return t.lineitem >> v.rollup(_.l_returnflag, _.l_linestatus, q=_.l_quantity.sum())


# --- windows ------------------------------------------------------------------------------------------

@query("""SELECT o_orderkey, dense_rank() OVER w::BIGINT AS dr, rank() OVER w::BIGINT AS mr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::BIGINT AS rn
 FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY round(o_totalprice / 1000))""")
def ranks(t):
    return (t.orders >> v.mutate(k=(_.o_totalprice / 1000).round()) >> v.group_by(_.o_orderpriority) >> v.arrange(_.o_orderkey)
            >> v.mutate(dr=big(v.dense_rank(_.k)), mr=big(v.min_rank(_.k)), pr=v.percent_rank(_.k).round(8), cd=v.cume_dist(_.k).round(8), rn=big(v.row_number(_))) >> v.ungroup() >> v.select(_.o_orderkey, _.dr, _.mr, _.pr, _.cd, _.rn))


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after2, round(sum(value) OVER w, 4) AS running, max(value) OVER w AS top, round(avg(value) OVER w, 10) AS mean, round(value - lag(value) OVER w, 6) AS change
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_values(t):
    return (t.events >> v.group_by(_.user_id) >> v.arrange(_.event_id)
            >> v.mutate(before=v.lag(_.value), after2=v.lead(_.value, 2), running=_.value.cumsum().round(4), top=_.value.cummax(), mean=v.cummean(_.value).round(10), change=_.value.diff().round(6))
            >> v.ungroup() >> v.select(_.event_id, _.before, _.after2, _.running, _.top, _.mean, _.change))


@query("""SELECT event_id, bool_and(value > 5) OVER w AS all_so_far, bool_or(value > 50) OVER w AS any_so_far, first_value(value) OVER f AS first, nth_value(value, 2) OVER f AS second, last_value(value) OVER f AS last
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def positions(t):
    return (t.events >> v.group_by(_.user_id) >> v.arrange(_.event_id)
            >> v.mutate(all_so_far=v.cumall(_.value > 5), any_so_far=v.cumany(_.value > 50), first=v.first(_.value), second=v.nth(_.value, 1), last=v.last(_.value))
            >> v.ungroup() >> v.select(_.event_id, _.all_so_far, _.any_so_far, _.first, _.second, _.last))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2.0::DOUBLE AS avg_rank FROM orders")
def average_rank(t):
    return t.orders >> v.group_by(_.o_orderstatus) >> v.mutate(avg_rank=_.o_custkey.rank()) >> v.ungroup() >> v.select(_.o_orderkey, _.avg_rank)


@query("SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey)::BIGINT AS kinds FROM orders")
def distinct_over_group(t):
    return t.orders >> v.group_by(_.o_custkey) >> v.mutate(kinds=v.n_distinct(_.o_orderpriority)) >> v.ungroup() >> v.select(_.o_orderkey, _.kinds)


@query("""SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
 first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM (SELECT *, CASE WHEN value > 20 THEN value END AS x FROM events)""")
def fill_gaps(t):
    return (t.events >> v.mutate(x=v.case_when({_.value > 20: _.value})) >> v.group_by(_.user_id) >> v.arrange(_.event_id) >> v.mutate(ffill=_.x.ffill(), bfill=_.x.bfill())
            >> v.ungroup() >> v.select(_.event_id, _.ffill, _.bfill))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1")
def filter_by_rank(t):
    return t.lineitem >> v.group_by(_.l_orderkey) >> v.filter(v.min_rank(v.desc(_.l_extendedprice)) == 1) >> v.ungroup() >> v.select(_.l_orderkey, _.l_linenumber)


# --- joins --------------------------------------------------------------------------------------------

@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(t):
    return t.nation >> v.inner_join(t.region, {"n_regionkey": "r_regionkey"}) >> v.select(_.n_name, _.r_name)


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(t):
    return t.customer >> v.left_join(t.orders, {"c_custkey": "o_custkey"}) >> v.select(_.c_custkey, _.o_orderkey)


@query("SELECT r.c_custkey, l.c_name AS c_name_x, r.c_name AS c_name_y FROM customer l RIGHT JOIN customer r ON l.c_custkey = r.c_custkey")
def join_right_self(t):
    own = t.customer >> v.select(_.c_custkey, _.c_name)
    return own >> v.right_join(own, "c_custkey")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, n_chars, quality::BIGINT AS quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def join_full(t):
    return t.documents >> v.full_join(t.labels, "doc_id") >> v.transmute(_.doc_id, _.n_chars, quality=big(_.quality))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(t):
    return t.customer >> v.semi_join(t.orders >> v.filter(_.o_totalprice > 200000), {"c_custkey": "o_custkey"}) >> v.select(_.c_custkey)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_anti(t):
    return t.documents >> v.anti_join(t.labels, "doc_id") >> v.select(_.doc_id)


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice < o_totalprice")
def join_theta(t):
    return v.inner_join(t.lineitem, t.orders, sql_on=lambda a, b: (a.l_orderkey == b.o_orderkey) & (a.l_extendedprice < b.o_totalprice)) >> v.select(_.l_orderkey, _.l_linenumber, _.o_custkey)


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_star(t):
    return (t.lineitem >> v.inner_join(t.orders, {"l_orderkey": "o_orderkey"}) >> v.inner_join(t.customer, {"o_custkey": "c_custkey"}) >> v.inner_join(t.nation, {"c_nationkey": "n_nationkey"})
            >> v.group_by(_.n_name) >> v.summarize(revenue=(_.l_extendedprice * (1 - _.l_discount)).sum().round(0)))


@query("SELECT n_nationkey::BIGINT AS k FROM nation UNION SELECT r_regionkey::BIGINT FROM region")
def set_union(t):
    return (t.nation >> v.transmute(k=big(_.n_nationkey))) >> v.union(t.region >> v.transmute(k=big(_.r_regionkey)))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersect_except(t):
    pos = t.customer >> v.filter(_.c_acctbal > 0) >> v.transmute(k=_.c_custkey)
    pending = t.orders >> v.filter(_.o_orderstatus == "P") >> v.transmute(k=_.o_custkey)
    return (t.orders >> v.transmute(k=_.o_custkey)) >> v.intersect(pos) >> v.setdiff(pending)


# --- reshape ------------------------------------------------------------------------------------------

@query("UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem) ON l_quantity, l_discount INTO NAME key VALUE value")
def gather_long(t):
    return t.lineitem >> v.select(_.l_orderkey, _.l_linenumber, _.l_quantity, _.l_discount) >> v.gather("key", "value", _.l_quantity, _.l_discount)


@query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS F, coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) AS O FROM lineitem GROUP BY 1")
def spread_wide(t):
    out = t.lineitem >> v.group_by(_.l_returnflag, _.l_linestatus) >> v.summarize(q=_.l_quantity.sum()) >> v.spread("l_linestatus", "q")
    return out >> v.mutate(O=_.O.fillna(0.0))


@query("SELECT o_orderkey, k AS kind, val AS value FROM (SELECT o_orderkey, unnest(['total', 'half']) AS k, unnest([o_totalprice, o_totalprice / 2]) AS val FROM orders)")
def pivot_longer_prefix(t):
    return t.orders >> v.transmute(_.o_orderkey, p_total=_.o_totalprice, p_half=_.o_totalprice / 2) >> v.pivot_longer(-_.o_orderkey, names_to="kind", names_prefix="p_")


@query("SELECT l_orderkey, l_linenumber, 'a' AS part, l_quantity AS x, l_tax AS y FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'b', l_extendedprice, l_discount FROM lineitem")
def pivot_longer_value(t):
    return t.lineitem >> v.transmute(_.l_orderkey, _.l_linenumber, x_a=_.l_quantity, y_a=_.l_tax, x_b=_.l_extendedprice, y_b=_.l_discount) >> v.pivot_longer(-_["l_orderkey", "l_linenumber"], names_to=[".value", "part"], names_sep="_")


@query("SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS F, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS O, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS P FROM orders GROUP BY 1")
def pivot_wider_max(t):
    return t.orders >> v.select(_.o_orderpriority, _.o_orderstatus, _.o_totalprice) >> v.pivot_wider(names_from=_.o_orderstatus, values_from=_.o_totalprice)


@query("SELECT conv_id, len(list(text))::BIGINT AS turns FROM conversations GROUP BY conv_id")
def nest_rows(t):
    return t.conversations >> v.nest(-_.conv_id) >> v.transmute(_.conv_id, turns=v.sql_raw("cast(size(data) as bigint)"))


@query("SELECT conv_id, turn, role FROM conversations")
def nest_unnest(t):
    return t.conversations >> v.select(_.conv_id, _.turn, _.role) >> v.nest(-_.conv_id) >> v.unnest("data")


@query("SELECT vec_id, unnest(embedding)::DOUBLE AS embedding FROM embeddings")
def unnest_array(t):
    return t.embeddings >> v.select(_.vec_id, _.embedding) >> v.unnest("embedding") >> v.mutate(embedding=_.embedding.astype("float"))


@query("SELECT * FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT DISTINCT l_linestatus FROM lineitem)")
def expand_grid(t):
    return t.lineitem >> v.expand(_.l_returnflag, _.l_linestatus)


@query("""SELECT a.l_returnflag, b.l_linestatus, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) b
 LEFT JOIN (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) c ON a.l_returnflag = c.l_returnflag AND b.l_linestatus = c.l_linestatus""")
def complete_counts(t):
    return t.lineitem >> v.count(_.l_returnflag, _.l_linestatus) >> v.complete(_.l_returnflag, _.l_linestatus, fill={"n": 0})


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1)::BIGINT AS level, split_part(o_orderpriority, '-', 2) AS word FROM orders")
def separate_convert(t):
    return t.orders >> v.select(_.o_orderkey, _.o_orderpriority) >> v.separate(_.o_orderpriority, ["level", "word"], sep="-", convert=True)


@query("SELECT c_custkey, nullif(regexp_extract(c_name, '([A-Za-z]+)#0*(\\d+)', 1), '') AS who, regexp_extract(c_name, '([A-Za-z]+)#0*(\\d+)', 2)::BIGINT AS num FROM customer")
def extract_groups(t):
    return t.customer >> v.select(_.c_custkey, _.c_name) >> v.extract(_.c_name, ["who", "num"], regex=r"([A-Za-z]+)#0*(\d+)", convert=True)


@query("SELECT n_nationkey, n_name || '/' || n_regionkey AS place FROM nation")
def unite_columns(t):
    return t.nation >> v.unite("place", _.n_name, _.n_regionkey, sep="/")


# --- strings, dates, missing values, factors -------------------------------------------------------------

@query("""SELECT p_partkey, upper(p_name) AS up, length(p_name)::BIGINT AS len, replace(p_brand, '#', '-') AS rep, p_type LIKE '%BRASS' AS brass, contains(p_name, 'an') AS an, (strpos(p_name, 'a') - 1)::BIGINT AS at,
 lpad(p_size::VARCHAR, 6, '0') AS z, p_name[2:4] AS mid, trim('  x ' || p_brand || ' ') AS trimmed FROM part""")
def string_functions(t):
    return t.part >> v.transmute(
        _.p_partkey, up=_.p_name.str.upper(), len=big(_.p_name.str.len()), rep=_.p_brand.str.replace("#", "-", regex=False), brass=_.p_type.str.endswith("BRASS"), an=_.p_name.str.contains("an"), at=big(_.p_name.str.find("a")),
        z=_.p_size.astype("str").str.zfill(6), mid=_.p_name.str.slice(1, 4), trimmed=v.str_c("  x ", _.p_brand, " ").str.strip())


@query("SELECT doc_id, len(string_split(text, ' '))::BIGINT AS parts, len(regexp_extract_all(text, '[aeiou]'))::BIGINT AS vowels, string_split(text, ' ')[1] AS first FROM documents")
def string_lists(t):
    return t.documents >> v.transmute(_.doc_id, parts=v.sql_raw("cast(size(split(text, ' ')) as bigint)"), vowels=big(_.text.str.count("[aeiou]")), first=_.text.str.split(" ").str.get(0))


@query("""SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, quarter(o_orderdate)::BIGINT AS q, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, (isodow(o_orderdate) - 1)::BIGINT AS dow, dayofyear(o_orderdate)::BIGINT AS doy, week(o_orderdate)::BIGINT AS wk,
 day(last_day(o_orderdate))::BIGINT AS dim, day(o_orderdate) = 1 AS ms, o_orderdate::DATE = last_day(o_orderdate) AS me, monthname(o_orderdate) AS mname, dayname(o_orderdate) AS dname FROM orders""")
def date_parts(t):
    d = _.o_orderdate.dt
    return t.orders >> v.transmute(_.o_orderkey, y=big(d.year), q=big(d.quarter), m=big(d.month), d=big(d.day), dow=big(d.dayofweek), doy=big(d.dayofyear), wk=big(d.week), dim=big(d.days_in_month), ms=d.is_month_start, me=d.is_month_end, mname=d.month_name(), dname=d.day_name())


@query("SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS m, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS h, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def date_floor(t):
    return t.events >> v.transmute(m=v.floor_date(_.ts, "MS").dt.strftime("%Y-%m-%d"), h=v.floor_date(_.ts, "H").dt.strftime("%Y-%m-%d %H")) >> v.count(_.m, _.h)


@query("SELECT event_id, coalesce(x, -1) AS filled, x IS NULL AS gone, nullif(event_type, 'click') AS kind, coalesce(x, value, 0) AS some FROM (SELECT *, CASE WHEN value > 20 THEN value END AS x FROM events)")
def missing_values(t):
    return t.events >> v.mutate(x=v.case_when({_.value > 20: _.value})) >> v.transmute(_.event_id, filled=_.x.fillna(-1.0), gone=_.x.isna(), kind=v.na_if(_.event_type, "click"), some=v.coalesce(_.x, _.value, 0.0))


@query("SELECT l_orderkey, l_linenumber, floor(l_quantity / 7)::BIGINT AS fd, round(l_quantity - 7 * floor(l_quantity / 7), 6) AS md, least(greatest(l_quantity, 10), 30) AS cl, l_quantity BETWEEN 5 AND 10 AS bt, round(pow(l_quantity, 2), 4) AS sq, round(sqrt(l_extendedprice), 6) AS rt, abs(l_quantity - 25) AS ab FROM lineitem")
def arithmetic(t):
    import numpy as np

    q = _.l_quantity
    return t.lineitem >> v.transmute(_.l_orderkey, _.l_linenumber, fd=big(q // 7), md=(q % 7).round(6), cl=q.clip(10, 30), bt=v.between(q, 5, 10), sq=(q**2).round(4), rt=np.sqrt(_.l_extendedprice).round(6), ab=(q - 25).abs())


@query("SELECT l_shipmode, n::BIGINT AS n FROM (SELECT CASE WHEN event_type IN (SELECT event_type FROM (SELECT event_type, count(*) AS c FROM events GROUP BY 1 ORDER BY c DESC, event_type LIMIT 2)) THEN event_type ELSE 'Other' END AS l_shipmode, count(*) AS n FROM events GROUP BY 1)")
def factor_lump(t):
    return t.events >> v.transmute(l_shipmode=_.event_type) >> v.fct_lump("l_shipmode", n=2) >> v.count(_.l_shipmode)


@query("SELECT event_id, (r - 1)::BIGINT AS code FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1) USING (event_type)")
def factor_codes(t):
    return t.events >> v.fct_infreq("event_type") >> v.transmute(_.event_id, code=big(_.event_type.cat.codes))


@query("SELECT o_orderstatus AS s, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS c, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def factor_collapse(t):
    return t.orders >> v.transmute(s=_.o_orderstatus, c=v.fct_collapse(_.o_orderstatus, {"done": ["F"], "open": ["O"]}, group_other="other")) >> v.count(_.s, _.c)


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 3) AS total FROM events GROUP BY user_id")
def apply_in_pandas(t):
    def one(pdf):
        return pdf.groupby("user_id", as_index=False).agg(n=("value", "size"), total=("value", "sum")).round({"total": 3})

    return t.events >> v.select(_.user_id, _.value) >> v.group_by(_.user_id) >> v.group_apply(one, "user_id long, n long, total double")


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM events GROUP BY 1")
def event_time_windows(t):
    return t.events >> v.group_by(w=v.time_window(_.ts, "1 hour")) >> v.summarize(n=v.n(_)) >> v.transmute(start=v.sql_raw("date_format(w.start, 'yyyy-MM-dd HH:mm:ss')"), n=_.n)


@query("SELECT name, band, plays FROM (VALUES ('Mick', 'Stones'), ('John', 'Beatles'), ('Paul', 'Beatles')) m(name, band) LEFT JOIN (VALUES ('John', 'guitar'), ('Paul', 'bass'), ('Keith', 'guitar')) i(name, plays) USING (name)")
def packaged_data(t):
    return v.load_dataset(t._spark, "band_members") >> v.left_join(v.load_dataset(t._spark, "band_instruments"), "name")


@query("SELECT o_orderkey, round(o_totalprice / 1000, 3) AS k FROM orders")
def user_functions(t):
    @v.column_function("elwise")
    def in_thousands(c, x):
        return x / 1000

    @v.verb
    def all_orders(x):
        return x >> v.filter(_.o_orderkey.notna())

    return v.pipe(t.orders, all_orders(), v.call(lambda d: d >> v.transmute(_.o_orderkey, k=in_thousands(_.o_totalprice).round(3))))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN o_totalprice END AS w, CASE WHEN NOT o_totalprice > 150000 THEN o_totalprice END AS m, CASE o_orderstatus WHEN 'F' THEN 'x' ELSE o_orderstatus END AS r FROM orders")
def conditional_ops(t):
    return t.orders >> v.transmute(_.o_orderkey, w=_.o_totalprice.where(_.o_totalprice > 150000), m=_.o_totalprice.mask(_.o_totalprice > 150000), r=_.o_orderstatus.replace("F", "x"))


@query("SELECT event_id, ntile(4) OVER (ORDER BY event_id)::BIGINT AS part FROM events")
def ntile_parts(t):
    return t.events >> v.transmute(_.event_id, part=big(v.ntile(_.event_id, 4)))
