"""Every operation in the registry: against pandas where it has one, or refused with its name."""

import warnings

import numpy as np
import pandas as pd
import pytest

import verbena as v
from verbena import _
from verbena.functions import registry
from verbena.functions.dates import ceil_date, floor_date

warnings.simplefilter("ignore")

NUM = pd.DataFrame({"id": range(1, 9), "g": list("aaabbbbc"), "x": [10.0, 11, 11, 13, 13, np.nan, 5, 2], "y": [1.0, 2, 3, 4, 5, 6, 7, 8]})
STR = pd.DataFrame({"id": range(1, 8), "x": ["abc", "Cde fg", "FG", "", " h1 ", "12", "x-y_z"]})
DT = pd.DataFrame({"id": range(1, 6), "x": pd.to_datetime(["2019-01-01 01:01:01", "2020-04-08 02:02:02", "2021-07-15 03:03:03.25", "2022-12-31 23:59:59", "2024-02-29 00:00:00"], format="ISO8601").astype("datetime64[ns]")})
BOOL = pd.DataFrame({"id": range(1, 5), "x": [True, False, True, False], "y": [True, True, False, False]})


def frame(spark, name):
    pdf = {"num": NUM, "str": STR, "dt": DT, "bool": BOOL}[name]
    df = spark.createDataFrame(pdf)
    if name == "num":
        return df.selectExpr("id", "g", "nullif(x, double('NaN')) AS x", "y")
    return df.selectExpr("id", "cast(x AS timestamp_ntz) AS x") if name == "dt" else df


def same(got, want):
    for a, b in zip(got, want, strict=True):
        if isinstance(b, (float, np.floating)) and np.isnan(b) or b is pd.NaT or b is None:
            assert a is None or a != a, (got, want)
        elif isinstance(b, (float, np.floating)):
            assert a == pytest.approx(float(b), rel=1e-9, abs=1e-9), (got, want)
        else:
            assert a == (b.item() if isinstance(b, np.generic) else b), (got, want)


def row_wise(spark, name, expr):
    t = v.tbl(frame(spark, name)) >> v.arrange(_.id) >> v.mutate(out=expr)
    return [r["out"] for r in t.to_spark().orderBy("id").collect()]


ELEMENT = {
    "num": ["_.x + _.y", "_.x.add(1)", "_.y - _.x", "_.x.sub(1)", "_.x * 2", "2 - _.x", "_.y / _.x", "_.x.rdiv(3)", "_.y // 3", "_.y.floordiv(3)", "_.y % 3", "-_.y % 3", "_.y.mod(4)", "_.y ** 2", "2 ** _.y", "_.y.pow(2)", "_.y == 3", "_.y.eq(3)", "_.y != 3", "_.y < 3", "_.y.le(3)",
            "_.y > 3", "_.y.ge(3)", "-_.x", "+_.x", "_.x.abs()", "_.x.clip(3, 11)", "_.y.isin([1, 2])", "_.y.between(2, 5)", "_.x.fillna(0.0)", "_.x.isna()", "_.x.notna()", "_.x.combine_first(_.y)", "_.y.where(_.y > 3)", "_.y.mask(_.y > 3)", "_.y.replace(3, 9)", "_.y.astype('int')", "_.y.round(1)",
            "np.sqrt(_.y)", "np.log(_.y)", "np.exp(_.y)", "np.floor(_.x)", "np.abs(_.x)", "(_.y / 3).round(2)", "_.y.copy()", "1 / (_.y - 3)"],
    "bool": ["_.x & _.y", "_.x | _.y", "_.x ^ _.y", "~_.x", "_.x == _.y"],
    "str": ["_.x.str." + f for f in ["upper()", "lower()", "len()", "capitalize()", "swapcase()", "strip()", "lstrip()", "rstrip()", "startswith('a')", "endswith('c')", "contains('[a-c]')", "contains('C', case=False)", "contains('-', regex=False)", "count('[a-z]')", "find('e')", "rfind('e')", "match('[a-z]')",
            "replace('[a-c]', '#', regex=True)", "replace('-', '+', regex=False)", "pad(8, 'left', '*')", "pad(8, 'both', '*')", "center(7)", "ljust(6, '.')", "rjust(6, '.')", "zfill(5)", "slice(1, 3)", "slice(-2)", "slice(0, 5, 2)", "slice_replace(1, 2, 'ZZ')", "isalpha()", "isalnum()", "isdigit()", "isspace()",
            "isnumeric()", "isupper()", "repeat(2)", "casefold()", "get(0)", "cat(_.x)"]] + ["_.x + '!'", "'<' + _.x"],
    "dt": ["_.x.dt." + f for f in ["year", "quarter", "month", "day", "hour", "minute", "second", "microsecond", "dayofweek", "weekday", "dayofyear", "days_in_month", "daysinmonth", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "is_year_start", "is_year_end", "is_leap_year", "day_name()", "month_name()",
           "date", "normalize()", "floor('h')", "ceil('D')", "strftime('%Y/%m/%d %H:%M')"]],
}


@pytest.mark.parametrize("name, text", [(k, x) for k, xs in ELEMENT.items() for x in xs if x != "_.x.str.get(0)"])
def test_row_by_row(spark, name, text):
    pdf = {"num": NUM, "str": STR, "dt": DT, "bool": BOOL}[name]
    want = eval(text, {"_": pdf, "np": np})
    if text in ("_.y.astype('int')",):
        want = want.astype(int)
    got = row_wise(spark, name, eval(text, {"_": _, "np": np}))
    want = [None if x is None or x is pd.NaT else x for x in want.tolist()]
    nulls = name == "num" and any(c in text for c in ("_.x",)) and isinstance(want[0], (bool, np.bool_))
    same([g if not (nulls and g is None) else False for g in got], want)


AGGREGATES = ["mean()", "sum()", "min()", "max()", "median()", "std()", "var()", "sem()", "skew()", "kurt()", "count()", "nunique()", "quantile(0.3)", "prod()"]


@pytest.mark.parametrize("text", AGGREGATES)
def test_aggregates(spark, text):
    """Whole, grouped, and as windows over both."""
    df = frame(spark, "num")
    name, args = text[:-1].split("(")
    args = [float(args)] if args else []
    expr = getattr(_.x, name)(*args)
    whole = getattr(NUM.x, name)(*args)
    grouped = NUM.groupby("g").x.apply(lambda s: getattr(s, name)(*args))
    if name == "sum":  # an empty sum is null here
        grouped = NUM.groupby("g").x.apply(lambda s: s.sum(min_count=1))
    same([(df >> v.summarize(o=expr)).to_spark().first()["o"]], [whole])
    got = {r["g"]: r["o"] for r in (df >> v.group_by(_.g) >> v.summarize(o=expr)).to_spark().collect()}
    same([got[k] for k in "abc"], [grouped[k] for k in "abc"])
    over = {r["id"]: r["o"] for r in (df >> v.group_by(_.g) >> v.mutate(o=expr)).to_spark().collect()}
    same([over[i] for i in NUM.id], [grouped[k] for k in NUM.g])
    same([r["o"] for r in (df >> v.mutate(o=expr)).to_spark().collect()], [whole] * len(NUM))


def test_more_aggregates(spark):
    df = frame(spark, "num")
    got = (df >> v.arrange(_.id) >> v.summarize(
        corr=_.x.corr(_.y), cov=_.x.cov(_.y), dot=_.y.dot(_.y), mad=_.y.mad(), size=_.x.size, empty=_.x.empty, nans=_.x.hasnans, uniq=_.y.is_unique, dup=_.x.is_unique, mode=_.x.mode(), up=_.y.is_monotonic_increasing, down=_.y.is_monotonic_decreasing,
        imax=_.x.idxmax(), imin=_.x.idxmin(), auto=_.y.autocorr(), eq=_.x.equals(_.x), first=_.y.first(), fvi=_.x.first_valid_index(), lvi=_.x.last_valid_index())).to_spark().first().asDict()
    want = {"corr": NUM.x.corr(NUM.y), "cov": NUM.x.cov(NUM.y), "dot": NUM.y.dot(NUM.y), "mad": (NUM.y - NUM.y.mean()).abs().mean(), "size": 8, "empty": False, "nans": True, "uniq": True, "dup": False, "up": True, "down": False,
            "imax": 3, "imin": 7, "auto": NUM.y.autocorr(), "eq": True, "first": 1.0, "fvi": 0, "lvi": 7}
    got.pop("mode")
    same([got[k] for k in want], list(want.values()))
    both = (frame(spark, "bool") >> v.summarize(a=_.x.all(), b=_.x.any(), c=(_.x | ~_.x).all(), d=_.x.sum(), e=_.x.mean())).to_spark().first()
    assert tuple(both) == (False, True, True, 2, 0.5)


WINDOWS = ["cumsum()", "cummax()", "cummin()", "cumprod()", "diff()", "diff(2)", "diff(-1)", "shift()", "shift(-2)", "pct_change()", "ffill()", "bfill()", "rank()", "rank(method='min')", "rank(method='dense')", "rank(method='max')", "rank(ascending=False)", "duplicated()", "interpolate()"]


@pytest.mark.parametrize("text", WINDOWS)
def test_windows(spark, text):
    df = v.tbl(frame(spark, "num")) >> v.arrange(_.id)
    expr = eval(f"_.x.{text}", {"_": _})
    for group in (False, True):
        source = NUM.groupby("g").x if group and not text.startswith(("duplicated", "interpolate")) else NUM.x
        if group and source is NUM.x:
            continue
        with pd.option_context("future.no_silent_downcasting", True):
            want = eval(f"s.{text.replace('pct_change()', 'pct_change(fill_method=None)')}", {"s": source})
        out = (df >> v.group_by(_.g) if group else df) >> v.mutate(o=expr)
        got = {r["id"]: r["o"] for r in out.to_spark().collect()}
        keep = NUM.x.notna() if text.startswith("cum") else NUM.x.notna() | True  # at a null SQL carries the running value on
        same([got[i] for i in NUM.id[keep]], want[keep].tolist())


def test_vector_functions(spark):
    t = v.tbl(frame(spark, "num")) >> v.arrange(_.id) >> v.group_by(_.g)
    out = t >> v.mutate(dr=v.dense_rank(_.x), mr=v.min_rank(v.desc(_.x)), all_=v.min_rank(_.x, na_option=None), pr=v.percent_rank(_.x), cd=v.cume_dist(_.x), rn=v.row_number(_.x), cm=v.cummean(_.x), nt=v.ntile(_.y, 2), l1=v.lag(_.y, 1, -1.0), n=v.n(_), last=v.last(_.y), second=v.nth(_.y, -2, order_by=_.y))
    got = {r["id"]: r for r in out.to_spark().collect()}
    assert [got[i]["dr"] for i in NUM.id] == [1, 2, 2, 2, 2, None, 1, 1] and [got[i]["mr"] for i in NUM.id] == [3, 1, 1, 1, 1, None, 3, 1]
    assert [got[i]["all_"] for i in (4, 5, 6, 7)] == [2, 2, 4, 1] and [got[i]["rn"] for i in NUM.id] == [1, 2, 3, 1, 2, 3, 4, 1]
    assert [got[i]["l1"] for i in NUM.id] == [-1, 1, 2, -1, 4, 5, 6, -1] and got[7]["n"] == 4 and got[1]["last"] == 3 and got[1]["second"] == 2
    assert got[8]["pr"] == 0 and got[7]["cd"] == pytest.approx(1 / 3) and got[6]["cm"] == 13
    out = v.tbl(frame(spark, "num")) >> v.transmute(b=v.between(_.x, 5, 11, default=False), c=v.coalesce(_.x, _.y), na=v.na_if(_.y, [1.0, 2.0]), near=v.near(_.y, _.y + 1e-12), s=v.str_c(_.g, "-", _.id), s2=v.str_c(_.g, _.g, sep="/"))
    assert out.to_spark().orderBy("s").first().asDict() == {"b": True, "c": 10.0, "na": None, "near": True, "s": "a-1", "s2": "a/a"}


@pytest.mark.parametrize("unit", ["S", "T", "H", "D", "W", "MS", "M", "QS", "Q", "AS", "A"])
def test_date_edges(spark, unit):
    x = DT.x
    got = row_wise(spark, "dt", floor_date(_.x, unit)), row_wise(spark, "dt", ceil_date(_.x, unit))
    if unit in ("S", "T", "H", "D"):
        low, high = x.dt.floor(unit.replace("T", "min").lower() if unit != "D" else "D"), x.dt.ceil(unit.replace("T", "min").lower() if unit != "D" else "D")
        assert [pd.Timestamp(t) for t in got[0]] == low.tolist() and [pd.Timestamp(t) for t in got[1]] == high.tolist()
        return
    offset = {"W": pd.offsets.Week(weekday=6), "MS": pd.offsets.MonthBegin(), "M": pd.offsets.MonthEnd(), "QS": pd.offsets.QuarterBegin(startingMonth=1), "Q": pd.offsets.QuarterEnd(), "AS": pd.offsets.YearBegin(), "A": pd.offsets.YearEnd()}[unit]
    for i, t in enumerate(x):
        day = t.normalize()
        assert pd.Timestamp(got[0][i]) == offset.rollback(day)
        assert pd.Timestamp(got[1][i]) in (offset.rollforward(day), offset.rollback(day) + offset)
        assert got[0][i] <= t <= got[1][i] or unit in ("M", "Q", "A", "W")


@pytest.mark.parametrize("name", sorted(registry.UNSUPPORTED))
def test_refused(spark, name):
    parts = name.split(".")
    x = _.x
    for p in parts:
        x = getattr(x, p)
    with pytest.raises(v.TranslationError, match="mutate, o"):
        frame(spark, "str") >> v.mutate(o=x if name != "T" else _.x.T)


def test_lists_and_codes(spark):
    df = frame(spark, "str")
    out = df >> v.transmute(_.id, s=_.x.str.split("-"), f=_.x.str.findall("[a-z]"), j=_.x.str.split("-").str.join("+"), e=_.x.str.extract("([A-Z])"), r=_.x.str.rsplit("-", 1), g=_.x.str.split("-").str.get(-1), i=_.x.str.split("-")[0], t=_.x.str.translate(str.maketrans({"a": "A", "b": None})))
    got = {r["id"]: r for r in out.to_spark().collect()}
    assert got[7]["s"] == ["x", "y_z"] and got[1]["f"] == ["a", "b", "c"] and got[7]["j"] == "x+y_z" and got[2]["e"] == "C" and got[1]["e"] is None
    assert got[7]["r"] == ["x", "y_z"] and got[7]["g"] == "y_z" and got[7]["i"] == "x" and got[1]["t"] == "Ac"
    f = v.tbl(frame(spark, "num")) >> v.arrange(_.id) >> v.mutate(o=_.x.factorize())
    assert [r["o"] for r in f.to_spark().orderBy("id").collect()] == pd.factorize(NUM.x)[0].tolist()


def test_casts(spark):
    df = frame(spark, "num")
    out = df >> v.transmute(s=_.y.astype("str"), i=_.y.astype(int), f=_.id.astype("float"), b=_.id.astype(bool))
    assert out.to_spark().dtypes == [("s", "string"), ("i", "bigint"), ("f", "double"), ("b", "boolean")]
    with pytest.raises(ValueError):
        df >> v.mutate(o=_.y.astype("category"))


def test_unused_categories_of_a_wide_column(spark):
    """A level that is used stays, however many other values the column has."""
    df = spark.range(150_000).selectExpr("cast(id AS string) AS x")
    levels = [str(i) for i in range(0, 150_000, 5_000)] + ["never"]
    t = v.tbl(df.withMetadata("x", {"levels": levels})) >> v.mutate(x=_.x.cat.remove_unused_categories())
    assert t.to_spark().schema["x"].metadata["levels"] == levels[:-1]


ROUNDS = [41.77 / 25.6 - 1, 1 - 41.77 / 25.6, 2.675, 1.005, 0.285, 258.4815, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 0.125, -0.004, 1250.0, -1350.0, 123456789012.12345678, 1e15 + 0.5, 1e301, 1.7e308, float("inf"), float("-inf"), None]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 8, 12, -2])
def test_round_of_doubles_is_that_of_sql(spark, n):
    import duckdb

    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, ?::INTEGER)", [x, n]).fetchall()[0][0] for x in ROUNDS]
    if n < 0:  # there DuckDB gives 0 for what is not finite
        want = [x if x is not None and np.isinf(x) else w for x, w in zip(ROUNDS, want, strict=True)]
    t = v.tbl(spark.createDataFrame(list(enumerate(ROUNDS)), "id long, x double"))
    got = [r["o"] for r in (t >> v.mutate(o=_.x.round(n))).to_spark().orderBy("id").collect()]
    assert list(map(repr, got)) == list(map(repr, want))
    of_sums = [r["o"] for r in (t >> v.group_by(_.id) >> v.summarize(o=_.x.sum().round(n))).to_spark().orderBy("id").collect()]
    assert of_sums == want
    nan = v.tbl(spark.createDataFrame([(float("nan"),)], "x double")) >> v.mutate(o=_.x.round(n))
    assert np.isnan(nan.to_spark().first()["o"])


def test_round_of_a_window_computes_it_once(spark):
    out = v.tbl(frame(spark, "num")) >> v.group_by(_.g) >> v.arrange(_.id) >> v.mutate(o=(1 + _.x / 3).cumprod().round(2))
    plan = out.to_spark()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("product(") == 1
