"""Queries for single column operations, several to a query, over whole tables, each with its SQL."""

from __future__ import annotations

import verbena as v
from verbena import _, Fx
from verbena.plans.queries import QUERIES, SQL, big, query

__all__ = ["QUERIES", "SQL"]

# --- operators and their method forms --------------------------------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, l_quantity >= 25 AS ge, l_quantity <> 25 AS ne, l_quantity < 10 OR l_tax > 0.05 AS o, (l_quantity < 10) <> (l_tax > 0.05) AS x, NOT (l_quantity < 10) AS inv, l_quantity AS pos, -l_quantity AS neg, round(l_extendedprice, 1) AS rnd, abs(l_quantity - 25) AS ab,
 xor(l_linenumber, 5)::BIGINT AS xi, (l_linenumber | 8)::BIGINT AS oi, (l_linenumber & 3)::BIGINT AS ai FROM lineitem""")
def operators(t):
    q, n = _.l_quantity, _.l_linenumber
    return t.lineitem >> v.transmute(_.l_orderkey, n, ge=q >= 25, ne=q != 25, o=(q < 10) | (_.l_tax > 0.05), x=(q < 10) ^ (_.l_tax > 0.05), inv=~(q < 10), pos=+q, neg=-q, rnd=round(_.l_extendedprice, 1), ab=abs(q - 25), xi=big(n ^ 5), oi=big(n | 8), ai=big(n & 3))


@query("""SELECT l_orderkey, l_linenumber, 10 + l_quantity AS radd, 10 - l_quantity AS rsub, 10 * l_quantity AS rmul, round(10 / l_quantity, 9) AS rdiv, (100 // l_linenumber)::BIGINT AS rfd, (100 % l_linenumber)::BIGINT AS rmd, pow(2, l_linenumber)::DOUBLE AS rpw,
 (5 & l_linenumber)::BIGINT AS rand, (8 | l_linenumber)::BIGINT AS ror, xor(5, l_linenumber)::BIGINT AS rxor, TRUE AND l_quantity > 5 AS rb FROM lineitem""")
def operators_reflected(t):
    q, n = _.l_quantity, _.l_linenumber
    return t.lineitem >> v.transmute(_.l_orderkey, n, radd=10 + q, rsub=10 - q, rmul=10 * q, rdiv=(10 / q).round(9), rfd=big(100 // n), rmd=big(100 % n), rpw=(2**n).astype("float"), rand=big(5 & n), ror=big(8 | n), rxor=big(5 ^ n), rb=True & (q > 5))


@query("""SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_quantity - l_tax AS s2, l_quantity * l_tax AS m, l_quantity * l_tax AS m2, round(l_tax / l_quantity, 12) AS d, round(l_tax / l_quantity, 12) AS d2, round(l_tax / l_quantity, 12) AS d3, (l_partkey // 7)::BIGINT AS fd,
 (l_partkey % 7)::BIGINT AS md, pow(l_quantity, 2)::DOUBLE AS pw, l_quantity = 25 AS eq, l_quantity <> 25 AS ne, l_quantity < 25 AS lt, l_quantity <= 25 AS le, l_quantity > 25 AS gt, l_quantity >= 25 AS ge FROM lineitem""")
def operator_methods(t):
    q, x, k = _.l_quantity, _.l_tax, _.l_partkey
    return t.lineitem >> v.transmute(
        _.l_orderkey, _.l_linenumber, a=q.add(x), s=q.sub(x), s2=q.subtract(x), m=q.mul(x), m2=q.multiply(x), d=x.div(q).round(12), d2=x.divide(q).round(12), d3=x.truediv(q).round(12), fd=k.floordiv(7), md=k.mod(7), pw=q.pow(2),
        eq=q.eq(25), ne=q.ne(25), lt=q.lt(25), le=q.le(25), gt=q.gt(25), ge=q.ge(25))


@query("""SELECT l_orderkey, l_linenumber, 3 + l_quantity AS a, 3 - l_quantity AS s, 3 * l_quantity AS m, round(3 / l_quantity, 9) AS d, round(3 / l_quantity, 9) AS d2, (1000 // l_linenumber)::BIGINT AS fd, (1000 % l_linenumber)::BIGINT AS md, pow(3, l_linenumber)::DOUBLE AS pw FROM lineitem""")
def operator_methods_reflected(t):
    q, n = _.l_quantity, _.l_linenumber
    return t.lineitem >> v.transmute(_.l_orderkey, n, a=q.radd(3), s=q.rsub(3), m=q.rmul(3), d=q.rdiv(3).round(9), d2=q.rtruediv(3).round(9), fd=big(n.rfloordiv(1000)), md=big(n.rmod(1000)), pw=n.rpow(3).astype("float"))


@query("""SELECT l_orderkey, l_linenumber, (x // 10)::BIGINT - CASE WHEN x < 0 AND x % 10 <> 0 THEN 1 ELSE 0 END AS fd, (x % 10 + CASE WHEN x < 0 AND x % 10 <> 0 THEN 10 ELSE 0 END)::BIGINT AS md, (x // 10)::BIGINT * -1 - CASE WHEN x > 0 AND x % 10 <> 0 THEN 1 ELSE 0 END AS fn
 FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END * (9007199254740993 + l_partkey) AS x FROM lineitem)""")
def whole_number_division(t):
    """Exact beyond 2**53, floors below zero."""
    x = _.x
    return (t.lineitem >> v.mutate(sign=v.if_else(_.l_linenumber % 2 == 0, 1, -1)) >> v.mutate(x=_.sign * (_.l_partkey + 9007199254740993))
            >> v.transmute(_.l_orderkey, _.l_linenumber, fd=x // 10, md=x % 10, fn=x // -10))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS r, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'x' ELSE o_orderstatus END AS m, abs(o_totalprice - round(o_totalprice, 1)) < 0.03 AS nr, o_totalprice AS cp, 'double' AS ty, 1::BIGINT AS nd FROM orders""")
def replace_near_and_properties(t):
    s, p = _.o_orderstatus, _.o_totalprice
    return t.orders >> v.transmute(_.o_orderkey, r=s.replace(["F", "O"], ["done", "open"]), m=s.replace(["F", "O"], "x"), nr=v.near(p, p.round(1), 0.03), cp=p.copy(), ty=p.dtype, nd=big(p.ndim))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem), 8) AS z, l_extendedprice > (SELECT avg(l_extendedprice) FROM lineitem) AS dear, round((SELECT skewness(l_tax) FROM lineitem), 6) AS sk FROM lineitem")
def standardize(t):
    """Several ungrouped aggregates in one verb: one pass, one broadcast row."""
    q = _.l_quantity
    return t.lineitem >> v.transmute(_.l_orderkey, _.l_linenumber, z=((q - q.mean()) / q.std()).round(8), dear=_.l_extendedprice > _.l_extendedprice.mean(), sk=_.l_tax.skew().round(6))


# --- aggregates ------------------------------------------------------------------------------------------

@query("""SELECT o_custkey, count(DISTINCT o_orderkey) = count(*) AS uq, round(product(1 + o_totalprice / 1e7), 8) AS pr, round(product(1 + o_totalprice / 1e7), 8) AS pr2, count(*)::BIGINT AS sz, FALSE AS em, bool_or(x IS NULL) AS hn, bool_and(x IS NOT DISTINCT FROM o_totalprice) AS eq,
 round(sum(o_totalprice * 2), 4) AS dt, round(sqrt(CASE WHEN count(*) > 2 THEN var_pop(o_totalprice) * count(*) / (count(*) - 2) END), 4) AS sd2, round(var_pop(o_totalprice), 2) AS v0, count(*)::BIGINT AS shp FROM (SELECT *, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS x FROM orders) GROUP BY 1""")
def aggregate_kinds(t):
    p = _.o_totalprice
    return (t.orders >> v.mutate(x=v.case_when({p > 50000: p}), two=2.0) >> v.group_by(_.o_custkey)
            >> v.summarize(uq=_.o_orderkey.is_unique, pr=(1 + p / 1e7).prod().round(8), pr2=(1 + p / 1e7).product().round(8), sz=p.size, em=p.empty, hn=_.x.hasnans, eq=_.x.equals(p), dt=p.dot(_.two).round(4), sd2=p.std(ddof=2).round(4), v0=p.var(ddof=0).round(2), shp=p.shape)
            >> v.mutate(shp=_.shp.str.get(0)))


@query("SELECT l_returnflag, mode(l_linestatus) AS mo, round(kurtosis(l_extendedprice), 6) AS ku, round(sum(l_quantity * l_tax), 2) AS mm FROM lineitem GROUP BY 1")
def aggregate_shapes_again(t):
    return t.lineitem >> v.group_by(_.l_returnflag) >> v.summarize(mo=_.l_linestatus.mode(), ku=_.l_extendedprice.kurtosis().round(6), mm=(_.l_quantity @ _.l_tax).round(2))


@query("""SELECT user_id, round(corr(value, before), 6) AS ac, coalesce(bool_and(value >= before), TRUE) AS up, coalesce(bool_and(value >= before), TRUE) AS up2, coalesce(bool_and(value <= before), TRUE) AS down, min(CASE WHEN value = top THEN p END)::BIGINT AS imax, min(CASE WHEN value = low THEN p END)::BIGINT AS imin,
 min(CASE WHEN value > 20 THEN p END)::BIGINT AS fv, max(CASE WHEN value > 20 THEN p END)::BIGINT AS lv, max(CASE WHEN p = 1 THEN value END) AS second, max(CASE WHEN b = 2 THEN value END) AS last_but_one
 FROM (SELECT *, lag(value) OVER w AS before, row_number() OVER w - 1 AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b, max(value) OVER (PARTITION BY user_id) AS top, min(value) OVER (PARTITION BY user_id) AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1""")
def aggregates_in_order(t):
    x = _.value
    return (t.events >> v.mutate(some=v.case_when({x > 20: x})) >> v.group_by(_.user_id) >> v.arrange(_.event_id)
            >> v.summarize(ac=x.autocorr().round(6), up=x.is_monotonic, up2=x.is_monotonic_increasing, down=x.is_monotonic_decreasing, imax=big(x.idxmax()), imin=big(x.idxmin()), fv=big(_.some.first_valid_index()), lv=big(_.some.last_valid_index()), second=v.nth(x, 1), last_but_one=v.nth(x, -2)))


@query("SELECT o_orderkey, o_totalprice AS it, o_totalprice > 100000 AS bo FROM orders")
def single_items(t):
    return t.orders >> v.mutate(high=_.o_totalprice > 100000) >> v.group_by(_.o_orderkey) >> v.summarize(it=_.o_totalprice.item(), bo=_.high.bool())


# --- values in order -------------------------------------------------------------------------------------

@query("""SELECT event_id, min(value) OVER w AS mn, round(product(1 + value / 1e6) OVER w, 9) AS pr, lag(value, 2) OVER w AS s2, lead(value) OVER w AS up, round(value / lag(value) OVER w - 1, 8) AS pct, row_number() OVER k > 1 AS d1, row_number() OVER l > 1 AS dl, count(*) OVER (PARTITION BY user_id, event_type) > 1 AS dn
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), k AS (PARTITION BY user_id, event_type ORDER BY event_id), l AS (PARTITION BY user_id, event_type ORDER BY event_id DESC)""")
def running_again(t):
    x, e = _.value, _.event_type
    return (t.events >> v.group_by(_.user_id) >> v.arrange(_.event_id)
            >> v.mutate(mn=x.cummin(), pr=(1 + x / 1e6).cumprod().round(9), s2=x.shift(2), up=x.shift(-1), pct=x.pct_change().round(8), d1=e.duplicated(), dl=e.duplicated(keep="last"), dn=e.duplicated(keep=False))
            >> v.ungroup() >> v.select(_.event_id, _.mn, _.pr, _.s2, _.up, _.pct, _.d1, _.dl, _.dn))


@query("""SELECT event_id, round(CASE WHEN pb = pa OR pa IS NULL THEN lo ELSE lo + (hi - lo) * (p - pb) / (pa - pb) END, 8) AS ip, code
 FROM (SELECT *, max(CASE WHEN x IS NOT NULL THEN p END) OVER u AS pb, min(CASE WHEN x IS NOT NULL THEN p END) OVER d AS pa, last_value(x IGNORE NULLS) OVER u AS lo, first_value(x IGNORE NULLS) OVER d AS hi, (dense_rank() OVER (PARTITION BY user_id ORDER BY f) - 1)::BIGINT AS code
  FROM (SELECT *, min(p) OVER (PARTITION BY user_id, event_type) AS f FROM (SELECT *, CASE WHEN value > 20 THEN value END AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events))
  WINDOW u AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")
def interpolate_factorize(t):
    return (t.events >> v.mutate(x=v.case_when({_.value > 20: _.value})) >> v.group_by(_.user_id) >> v.arrange(_.event_id) >> v.mutate(ip=_.x.interpolate().round(8), code=big(_.event_type.factorize()))
            >> v.ungroup() >> v.select(_.event_id, _.ip, _.code))


@query("""SELECT o_orderkey, rank() OVER w::DOUBLE AS mi, (rank() OVER w + count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1)::DOUBLE AS ma, dense_rank() OVER w::DOUBLE AS de, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey, o_orderkey)::BIGINT AS fi FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_custkey)""")
def rank_methods(t):
    k = _.o_custkey
    return (t.orders >> v.group_by(_.o_orderstatus) >> v.mutate(mi=k.rank(method="min"), ma=k.rank(method="max"), de=k.rank(method="dense"), both=k * 10000000 + _.o_orderkey) >> v.mutate(fi=big(_.both.rank(method="first")))
            >> v.ungroup() >> v.select(_.o_orderkey, _.mi, _.ma, _.de, _.fi))


# --- strings ---------------------------------------------------------------------------------------------

@query(r"""SELECT p_partkey, upper(left(x, 1)) || lower(substr(x, 2)) AS cap, lower(x) AS lo, lower(x) AS cf, translate(x, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS sw,
 array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS ti, rpad(x, 40, '.') AS lj, lpad(x, 40, '.') AS rj, lpad(x, 40, ' ') AS pd, repeat('*', (40 - length(x)) // 2) || x || repeat('*', 40 - length(x) - (40 - length(x)) // 2) AS ce,
 ltrim('xx' || x, 'x') AS ls, rtrim(x || 'yy', 'y') AS rs, repeat(p_brand, 2) AS rp, translate(x, 'ae', '43') AS tr, p_brand || '-' || x AS ct, 'ab' || substr(x, 4) AS sr, x AS ed
 FROM (SELECT *, p_name AS x FROM part WHERE length(p_name) <= 40)""")
def string_forms(t):
    x = _.p_name.str
    return t.part >> v.filter(x.len() <= 40) >> v.transmute(
        _.p_partkey, cap=x.capitalize(), lo=x.lower(), cf=x.casefold(), sw=x.swapcase(), ti=x.title(), lj=x.ljust(40, "."), rj=x.rjust(40, "."), pd=x.pad(40), ce=x.center(40, "*"), ls=v.str_c("xx", _.p_name).str.lstrip("x"), rs=v.str_c(_.p_name, "yy").str.rstrip("y"),
        rp=_.p_brand.str.repeat(2), tr=x.translate({97: "4", 101: "3"}), ct=_.p_brand.str.cat(_.p_name, sep="-"), sr=x.slice_replace(0, 3, "ab"), ed=x.encode("utf-8").str.decode("utf-8"))


@query(r"""SELECT o_orderkey, regexp_full_match(x, '[\p{L}\p{N}]+') AS an, regexp_full_match(x, '\p{L}+') AS al, regexp_full_match(x, '\p{Nd}+') AS de, regexp_full_match(x, '\p{Nd}+') AS di, regexp_full_match(x, '\p{N}+') AS nu, regexp_full_match(x, '\s+') AS sp, x = lower(x) AND regexp_matches(x, '[A-Za-z]') AS lw, x = upper(x) AND regexp_matches(x, '[A-Za-z]') AS up,
 x = array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AND regexp_matches(x, '[A-Za-z]') AS ti, starts_with(y, '1') AS st, regexp_matches(y, '^(?:[1-3]-)') AS ma, regexp_full_match(y, '\d-[A-Z]+') AS fm
 FROM (SELECT *, o_orderpriority AS y, CASE o_orderkey % 6 WHEN 0 THEN 'abc' WHEN 1 THEN 'ABC' WHEN 2 THEN '123' WHEN 3 THEN '' WHEN 4 THEN 'Ab Cd' ELSE '  ' END AS x FROM orders)""")
def string_tests(t):
    x, y, m = _.x.str, _.o_orderpriority.str, _.o_orderkey % 6
    return t.orders >> v.mutate(x=v.case_when({m == 0: "abc", m == 1: "ABC", m == 2: "123", m == 3: "", m == 4: "Ab Cd", True: "  "})) >> v.transmute(
        _.o_orderkey, an=x.isalnum(), al=x.isalpha(), de=x.isdecimal(), di=x.isdigit(), nu=x.isnumeric(), sp=x.isspace(), lw=x.islower(), up=x.isupper(), ti=x.istitle(), st=y.startswith("1"), ma=y.match("[1-3]-"), fm=y.fullmatch(r"\d-[A-Z]+"))


@query(r"""SELECT p_partkey, CASE WHEN strpos(reverse(p_type), 'S') = 0 THEN -1 ELSE length(p_type) - strpos(reverse(p_type), 'S') END AS rf, array_to_string(regexp_extract_all(p_type, '[A-Z]+'), '/') AS fa, array_to_string(regexp_extract_all(p_type, '([A-Z])[A-Z]+', 1), '') AS fg, nullif(regexp_extract(p_type, '([A-Z]+)$', 1), '') AS ex, array_to_string(string_split(p_type, ' '), '+') AS jo,
 CASE WHEN len(string_split(p_type, ' ')) > 2 THEN array_to_string(string_split(p_type, ' ')[:-2], ' ') ELSE string_split(p_type, ' ')[1] END AS rs FROM part""")
def string_parts(t):
    x = _.p_type.str
    return t.part >> v.transmute(_.p_partkey, rf=big(x.rfind("S")), fa=x.findall("[A-Z]+").str.join("/"), fg=x.findall("([A-Z])[A-Z]+").str.join(""), ex=x.extract("([A-Z]+)$"), jo=x.split(" ").str.join("+"), rs=x.rsplit(" ", n=1).str.get(0))


# --- dates -----------------------------------------------------------------------------------------------

@query("""SELECT event_id, hour(ts)::BIGINT AS h, minute(ts)::BIGINT AS mi, floor(second(ts))::BIGINT AS s, (microsecond(ts) % 1000000)::BIGINT AS us, 0::BIGINT AS ns, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S.%f') AS tm, (isodow(ts) - 1)::BIGINT AS wd, week(ts)::BIGINT AS wy, day(last_day(ts))::BIGINT AS dm,
 strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS nm, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS fl, strftime(CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS ce,
 round(epoch(ts - date_trunc('day', ts)), 6) AS sec, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS cv, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS lc FROM events""")
def time_parts(t):
    d, f = _.ts.dt, "%Y-%m-%d %H:%M:%S"
    return t.events >> v.transmute(
        _.event_id, h=big(d.hour), mi=big(d.minute), s=big(d.second), us=big(d.microsecond), ns=big(d.nanosecond), d=d.date.astype("str"), tm=d.time, wd=big(d.weekday), wy=big(d.weekofyear), dm=big(d.daysinmonth), nm=d.normalize().dt.strftime(f), fl=d.floor("H").dt.strftime(f), ce=d.ceil("H").dt.strftime(f),
        sec=(_.ts - d.normalize()).dt.total_seconds().round(6), cv=d.tz_convert("+02:00").dt.strftime(f), lc=d.tz_localize("+02:00").dt.strftime(f))


@query("""SELECT o_orderkey, d = date_trunc('quarter', d) AS qs, d = last_day(date_trunc('quarter', d) + INTERVAL 2 MONTH) AS qe, dayofyear(d) = 1 AS ys, month(d) = 12 AND day(d) = 31 AS ye, day(last_day(make_date(year(d), 2, 1))) = 29 AS ly,
 strftime(CASE WHEN epoch(o_orderdate - date_trunc('day', o_orderdate)) < 43200 THEN date_trunc('day', o_orderdate) ELSE date_trunc('day', o_orderdate) + INTERVAL 1 DAY END, '%Y-%m-%d') AS ro FROM (SELECT *, o_orderdate::DATE AS d FROM orders)""")
def date_edges(t):
    d = _.o_orderdate.dt
    return t.orders >> v.transmute(_.o_orderkey, qs=d.is_quarter_start, qe=d.is_quarter_end, ys=d.is_year_start, ye=d.is_year_end, ly=d.is_leap_year, ro=d.round("D").dt.strftime("%Y-%m-%d"))


# --- missing values, levels, names -------------------------------------------------------------------------

@query("SELECT event_id, x IS NULL AS n1, x IS NOT NULL AS n2, x IS NOT NULL AS n3, coalesce(x, value * -1) AS cf, NULL::VARCHAR AS nm FROM (SELECT *, CASE WHEN value > 20 THEN value END AS x FROM events)")
def missing_methods(t):
    x = _.x
    return t.events >> v.mutate(x=v.case_when({_.value > 20: _.value})) >> v.transmute(_.event_id, n1=x.isnull(), n2=x.notna(), n3=x.notnull(), cf=x.combine_first(_.value * -1), nm=x.name.astype("str"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END::BIGINT AS code, 'O,F,P' AS lv, 'O,F,P,Z' AS ad, 'O,P' AS rm, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE o_orderstatus END AS rn, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::BIGINT AS ro,
 CASE o_orderstatus WHEN 'O' THEN 'O' WHEN 'F' THEN 'F' END AS st, 'O,F,P' AS ru, TRUE AS oo, FALSE AS ou, 'open,F,P' AS rl FROM orders""")
def category_methods(t):
    x = _.s.cat
    return (t.orders >> v.mutate(s=_.o_orderstatus.cat.set_categories(["O", "F", "P"])) >> v.mutate(
                ad=x.add_categories(["Z"]), rm=x.remove_categories(["F"]), rn=x.rename_categories({"O": "open"}), ro=x.reorder_categories(["P", "O", "F"]), st=x.set_categories(["O", "F"]), up=x.as_ordered(), dn=x.as_unordered(), rc=v.fct_recode(_.s, open="O"))
            >> v.mutate(ru=_.ad.cat.remove_unused_categories())
            >> v.transmute(_.o_orderkey, code=big(x.codes), lv=x.categories.str.join(","), ad=_.ad.cat.categories.str.join(","), rm=_.rm.cat.categories.str.join(","), rn=_.rn, ro=big(_.ro.cat.codes), st=_.st, ru=_.ru.cat.categories.str.join(","), oo=_.up.cat.ordered, ou=_.dn.cat.ordered, rl=_.rc.cat.categories.str.join(",")))


@query("""SELECT event_id, (a - 1)::BIGINT AS ino, (b - 1)::BIGINT AS reo, (n - b)::BIGINT AS rev FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY first) AS a, row_number() OVER (ORDER BY m DESC, event_type) AS b, count(*) OVER () AS n
 FROM (SELECT event_type, min(event_id) AS first, max(value) AS m FROM events GROUP BY 1)) USING (event_type)""")
def factor_orders(t):
    e = t.events >> v.mutate(a=_.event_type, b=_.event_type, c=_.event_type) >> v.arrange(_.event_id) >> v.fct_inorder("a") >> v.fct_reorder("b", "value", func="max", desc=True) >> v.fct_reorder("c", "value", func="max", desc=True) >> v.fct_rev("c")
    return e >> v.transmute(_.event_id, ino=big(_.a.cat.codes), reo=big(_.b.cat.codes), rev=big(_.c.cat.codes))


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def select_by_type(t):
    return t.part >> v.select(v.where("number"))


@query("SELECT n_nationkey AS k___0, n_name AS name, n_regionkey AS k___2 FROM nation")
def repaired_names(t):
    names = v.vec_as_names(["k", "name", "k"], "unique")
    return v.tbl(t.nation.to_spark().toDF(*names))


# --- joins and pipes ---------------------------------------------------------------------------------------

@query("SELECT c_custkey, c_mktsegment, n_name, count(*) OVER (PARTITION BY c_mktsegment)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_grouped_left(t):
    """Groups of the left table go on through the join, whose small side is broadcast on request."""
    out = t.customer >> v.group_by(_.c_mktsegment) >> v.inner_join(t.nation, {"c_nationkey": "n_nationkey"}, broadcast=True) >> v.mutate(n=v.n(_))
    return out >> v.ungroup() >> v.select(_.c_custkey, _.c_mktsegment, _.n_name, _.n)


@query("""SELECT a.o_orderkey, b.tag, c.tag AS tag_na FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS k FROM orders) a LEFT JOIN (VALUES ('F', 'f'), (NULL, 'none')) b(k, tag) ON a.k = b.k LEFT JOIN (VALUES ('F', 'f'), (NULL, 'none')) c(k, tag) ON a.k IS NOT DISTINCT FROM c.k""")
def join_null_keys(t):
    spark = t._spark
    tags = v.tbl(spark.createDataFrame([("F", "f"), (None, "none")], "k string, tag string"))
    own = t.orders >> v.transmute(_.o_orderkey, k=v.na_if(_.o_orderstatus, "P"))
    return own >> v.left_join(tags, "k") >> v.left_join(tags >> v.rename(tag_na=_.tag), "k", na_matches="na") >> v.select(_.o_orderkey, _.tag, _.tag_na)


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def pipes_and_lambdas(t):
    steps = v.pipe(v.group_by(_.o_orderpriority), v.summarize(n=lambda d: v.n(d), mean=lambda d: d.o_totalprice.mean()), v.mutate(mean=lambda d: d.mean.round(4)))
    return v.pipe(t.orders, steps)


@query("SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def collect_and_back(t):
    """A result small by its nature goes to the driver as a pandas frame and back."""
    return v.tbl(t._spark, t.orders >> v.count(_.o_orderstatus) >> v.collect())


@query("SELECT user_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def json_values(t):
    return t.events >> v.transmute(_.user_id, _.event_type, k=v.sql_raw("get_json_object(props, '$.k')"))


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def across_by_name(t):
    return t.lineitem >> v.group_by(_.l_returnflag) >> v.summarize(v.across(_["l_quantity", "l_tax"], Fx.mean().round(6)))
