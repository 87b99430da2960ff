"""Verbs on small frames with known results."""

import warnings

import pandas as pd
import pytest

import verbena as v
from verbena import Fx, _


def rows(t, *cols, order=True):
    df = t.to_spark() if isinstance(t, v.Tbl) else t
    out = [tuple(r[c] for c in cols or df.columns) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r)) if order else out


@pytest.fixture(scope="module")
def mk(spark):
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def gx(mk):
    return mk([(x, 1 + (x > 5)) for x in range(1, 11)], "x long, g long")


def test_mutate_is_sequential_and_keeps_places(mk):
    df = mk([(1, 9), (2, 8), (3, 7)], "a long, b long")
    out = df >> v.mutate(_.b, a=_.a + 1, c=_.a * 10, d=7)
    assert out.columns == ["a", "b", "c", "d"] and rows(out)[0] == (2, 9, 20, 7)
    assert rows(df >> v.mutate(y=lambda _: _.a + 1), "y") == [(2,), (3,), (4,)]
    assert (df >> v.mutate()).columns == ["a", "b"]
    assert (df >> v.transmute(_.b, z=_.a)).columns == ["b", "z"]


def test_group_aggregates_in_mutate_and_filter(gx):
    g = gx >> v.group_by(_.g)
    assert rows(g >> v.filter(_.x > _.x.mean()), "x") == [(4,), (5,), (9,), (10,)]
    assert rows(g >> v.arrange(_.x) >> v.filter(v.row_number(_) < 3), "x") == [(1,), (2,), (6,), (7,)]
    assert rows(gx >> v.mutate(m=_.x - _.x.mean()), "m")[0] == (-4.5,)
    assert rows(g >> v.mutate(z=(_.x - _.x.mean()).max()), "z")[0] == (2.0,)


def test_null_groups_stay(mk):
    df = mk([(1, None), (2, None), (3, "a")], "x long, g string")
    assert rows(df >> v.group_by(_.g) >> v.summarize(s=_.x.sum())) == [(None, 3), ("a", 3)]
    assert rows(df >> v.group_by(_.g) >> v.mutate(s=_.x.sum()), "x", "s") == [(1, 3), (2, 3), (3, 3)]


def test_overwritten_keys_and_orders(mk):
    df = mk([(1, 1), (2, 1), (3, 2), (4, 2)], "x long, g long")
    out = df >> v.group_by(_.g) >> v.mutate(g=_.x.max()) >> v.summarize(n=v.n(_))
    assert rows(out) == [(2, 2), (4, 2)]
    out = df >> v.arrange(-_.x) >> v.mutate(x=_.x * 0) >> v.mutate(c=v.row_number(_))
    assert [r["c"] for r in out.to_spark().collect()] == [1, 2, 3, 4]
    # the order key goes on after it was renamed or left out
    out = df >> v.arrange(-_.x) >> v.rename(k=_.x) >> v.select(_.g) >> v.mutate(s=_.g.cumsum())
    assert rows(out, "s") == [(2,), (4,), (5,), (6,)] and out.columns == ["g", "s"]


def test_order_dependence_warns(gx):
    with pytest.warns(RuntimeWarning):
        gx >> v.mutate(c=_.x.cumsum())


def test_summarize_rules(gx):
    out = gx >> v.group_by(_.g) >> v.summarize(n=v.n(_), one=1, d=_.x.max() - _.x.min())
    assert out.columns == ["g", "n", "one", "d"] and out.group_by == () and rows(out) == [(1, 5, 1, 4), (2, 5, 1, 4)]
    with pytest.raises(v.TranslationError):
        gx >> v.summarize(a=_.x + 1)
    with pytest.raises(NotImplementedError):
        gx >> v.summarize(a=_.x.mean(), b=_.a + 1)
    with pytest.raises(NotImplementedError):
        gx >> v.summarize(a=_.x.cumsum())
    assert rows(gx >> v.summarize(a=(_.x - _.x.mean()).abs().sum())) == [(25.0,)]


def test_raw_sql(mk):
    df = mk([("a", 1), ("a", 2)], "x string, y long")
    assert rows(df >> v.group_by(_.x) >> v.summarize(z=v.sql_raw("sum(y)"), w=v.sql_raw("max(y)") + 1)) == [("a", 3, 3)]
    assert rows(df >> v.filter(v.sql_raw("y > 1")) >> v.mutate(z=v.sql_raw("y * 10") + _.y), "z") == [(22,)]


def test_count_names_and_weights(mk):
    df = mk([(1, 3), (2, 3)], "x long, n long")
    assert (df >> v.count(_.n)).columns == ["n", "nn"]
    with pytest.raises(ValueError):
        df >> v.count(_.n, name="n")
    assert rows(df >> v.count(wt=_.x)) == [(3,)] and rows(df >> v.count(big=_.x > 1), "big", "n") == [(False, 1), (True, 1)]
    assert rows(df >> v.add_count(_.n, sort=True), "nn") == [(2,), (2,)]


def test_group_by_forms(mk):
    df = mk([(1, 9, "a"), (2, 8, "a"), (3, 7, "b")], "x long, y long, g string")
    assert (df >> v.group_by(_.g) >> v.group_by(_.x)).group_by == ("x",)
    assert (df >> v.group_by(_.g) >> v.group_by(_.x, add=True)).group_by == ("g", "x")
    assert (df >> v.group_by(big=_.x > 1) >> v.ungroup()).group_by == ()
    out = df >> v.group_by(_.g) >> v.rename(h=_.g)
    assert out.group_by == ("h",)
    with pytest.warns(UserWarning):
        assert (df >> v.group_by(_.g) >> v.select(_.x)).columns == ["g", "x"]


def test_arrange(mk):
    df = mk([(2, 2, "a"), (2, None, "b"), (1, 1, "c")], "x long, y long, z string")
    assert rows(df >> v.arrange(_.x, -_.z), "z", order=False) == [("c",), ("b",), ("a",)]
    assert rows(df >> v.arrange(_.y), "y", order=False) == [(1,), (2,), (None,)]
    assert rows(df >> v.arrange(-_.y), "y", order=False) == [(2,), (1,), (None,)]
    assert rows(df >> v.arrange(v.desc(_.x), _.z) >> v.head(1), "z") == [("a",)]
    assert (df >> v.arrange(_.x % 2)).columns == ["x", "y", "z"]
    with pytest.raises(NotImplementedError):
        df >> v.arrange(v.across(_.x, Fx + 1))


def test_distinct(mk):
    df = mk([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "g string, x long")
    assert rows(df >> v.distinct()) == [("a", 1), ("b", 1), ("b", 2)]
    assert (df >> v.group_by(_.g) >> v.distinct(_.x)).columns == ["g", "x"]
    assert rows(df >> v.arrange(-_.x) >> v.distinct(_.g, _keep_all=True)) == [("a", 1), ("b", 2)]


def test_conditions(mk):
    df = mk([(0, 10), (1, 11), (None, 12)], "x long, y long")
    out = df >> v.transmute(a=v.case_when({_.x == 0: "zero", _.x == 1: _.y}), b=v.if_else(_.x > 0, "p", "q"), c=v.case_when({_.x == 0: 1, True: 9}))
    assert rows(out, order=False) == [("zero", "q", 1), ("11", "p", 9), (None, "q", 9)]


def test_across(mk):
    df = mk([(1, 3, 5.0, "m"), (2, 4, 6.0, "n")], "a_x long, a_y long, b_x double, g string")
    out = df >> v.mutate(v.across(_.startswith("a_"), Fx + 1))
    assert rows(out)[0] == (2, 4, 5.0, "m")
    out = df >> v.group_by(_.g) >> v.summarize(v.across(_[_.a_x : _.b_x], {"mx": Fx.max(), "d": lambda x: x.max() - x.min()}, names="{fn}.{col}"))
    assert out.columns == ["g", "mx.a_x", "d.a_x", "mx.a_y", "d.a_y", "mx.b_x", "d.b_x"]
    assert rows(df >> v.filter(v.across(_.startswith("a_"), Fx > 1)), "a_x") == [(2,)]
    assert rows(df >> v.mutate(v.across(_.a_x, Fx / _.b_x)), "a_x")[0] == (0.2,)
    assert (df >> v.group_by(v.across(_.g, Fx.str.upper()))).group_by == ("g",)
    with pytest.raises(TypeError):
        df >> v.mutate(v.across(_.a_x, [Fx.max()]))


@pytest.fixture(scope="module")
def lr(mk):
    left = mk([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "ii long, x string")
    return left, mk([(1, "a"), (2, "b"), (26, "z")], "ii long, y string"), mk([(1, "a"), (2, "b"), (26, "z")], "jj long, y string")


def test_joins(lr):
    a, b, c = lr
    assert rows(v.inner_join(a, b, "ii")) == rows(a >> v.inner_join(_, c, {"ii": "jj"})) == [(1, "a", "a"), (2, "b", "b")]
    assert (a >> v.left_join(c, {"ii": "jj"})).columns == ["ii", "x", "y"]
    assert rows(v.left_join(a, b, on="ii"), "ii", "y") == [(1, "a"), (2, "b"), (3, None), (4, None)]
    assert rows(v.right_join(a, c, {"ii": "jj"}), "ii", "x") == [(1, "a"), (2, "b"), (26, None)]
    assert rows(v.full_join(a, b, "ii"), "ii", "x", "y") == [(1, "a", "a"), (2, "b", "b"), (3, "c", None), (4, "d", None), (26, None, "z")]
    assert rows(v.semi_join(a, b, "ii")) == [(1, "a"), (2, "b")] and rows(v.anti_join(a, b, by="ii"), "ii") == [(3,), (4,)]
    with pytest.warns(UserWarning):
        assert rows(v.semi_join(a, b), "ii") == [(1,), (2,)]
    with pytest.raises(KeyError):
        v.inner_join(a, b, {"no": "ii"})
    with pytest.raises(ValueError):
        v.join(a, b, "ii", how="sideways")
    assert (a >> v.group_by(_.x) >> v.inner_join(b, "ii")).group_by == ("x",)


def test_join_conditions_and_suffixes(lr, mk):
    a, b, _c = lr
    out = v.left_join(a, b, sql_on=lambda l, r: l.ii > r.ii)
    assert rows(out, "ii_x", "ii_y", "x", "y") == [(1, None, "a", None), (2, 1, "b", "a"), (3, 1, "c", "a"), (3, 2, "c", "b"), (4, 1, "d", "a"), (4, 2, "d", "b")]
    assert rows(v.anti_join(a, b, sql_on=lambda l, r: l.ii > r.ii)) == [(1, "a")]
    assert v.inner_join(a, a, {"ii": "ii"}).columns == ["ii", "x_x", "x_y"]
    twice = mk([(1,), (1,)], "ii long")
    assert rows(v.semi_join(a, twice, "ii")) == [(1, "a")]
    nulls = mk([(None, 1)], "k string, q long")
    assert rows(v.inner_join(nulls, nulls, "k")) == [] and len(rows(v.inner_join(nulls, nulls, "k", na_matches="na"))) == 1


def test_sets(mk):
    a, b = mk([(1,), (2,), (2,)], "x long"), mk([(2,), (3,)], "x long")
    assert rows(v.union(a, b)) == [(1,), (2,), (3,)] and rows(a >> v.union_all(b)) == [(1,), (2,), (2,), (2,), (3,)]
    assert rows(v.intersect(a, b)) == [(2,)] and rows(v.setdiff(a, b)) == [(1,)]
    assert rows(v.bind_rows(a, mk([(9,)], "y long"))) == [(None, 9), (1, None), (2, None), (2, None)]


def test_head_top_n(mk):
    df = mk([(i, "xy"[i % 2]) for i in range(1, 7)], "a long, g string")
    assert len(rows(df >> v.group_by(_.g) >> v.head(2))) == 2
    assert rows(df >> v.group_by(_.g) >> v.top_n(1, _.a), "a") == [(5,), (6,)]
    assert rows(df >> v.top_n(-2, _.a), "a") == [(1,), (2,)] and rows(df >> v.arrange(_.a) >> v.tail(2), "a") == [(5,), (6,)]


def test_row_counts(mk):
    df = mk([(1, "a"), (2, None), (0, "c")], "x long, g string")
    assert rows(df >> v.repeat_rows(_.x), "x") == [(1,), (2,), (2,)] and rows(df >> v.drop_missing(_.g), "x") == [(0,), (1,)]
    assert (df >> v.summary("count")).to_spark().count() == 1 and len(rows(df >> v.sample_rows(1.0))) == 3
    assert rows(df >> v.fast_filter(_.x > 0), "x") == [(1,), (2,)]


def test_spread_gather(mk):
    long = mk([(1, "a", 1), (1, "b", 2), (2, "b", 3)], "id long, m string, v long")
    assert rows(long >> v.spread("m", "v")) == [(1, 1, 2), (2, None, 3)]
    assert rows(long >> v.spread(_.m, _.v, fill=0)) == [(1, 1, 2), (2, 0, 3)]
    with pytest.raises(Exception, match="more than one"):
        (mk([(1, "a", 1), (1, "a", 2)], "id long, m string, v long") >> v.spread("m", "v")).to_spark().collect()
    wide = mk([(1, 1.0, 2.0), (2, None, 3.0)], "id long, a double, b double")
    assert rows(wide >> v.gather("k", "v", -_.id)) == [(1, "a", 1.0), (1, "b", 2.0), (2, "a", None), (2, "b", 3.0)]
    assert len(rows(wide >> v.gather("k", "v", -_.id, drop_na=True))) == 3


def test_pivots(mk):
    df = mk([("A", 1, 2, "a"), ("B", 3, 4, "b")], "id string, x_1 long, x_2 long, y_2 string")
    out = df >> v.pivot_longer(~_.id, names_to=[".value", "number"], names_sep="_")
    assert out.columns == ["id", "number", "x", "y"] and rows(out) == [("A", "1", 1, None), ("A", "2", 2, "a"), ("B", "1", 3, None), ("B", "2", 4, "b")]
    out = mk([(1, None), (None, 2)], "x long, y long") >> v.pivot_longer(_.x, _.y, values_drop_na=True)
    assert rows(out) == [("x", 1), ("y", 2)]
    spec = v.build_longer_spec(df, _.x_1, _.x_2, names_to="k", names_pattern=r"x_(\d)", names_ptypes={"k": int})
    assert [r["k"] for r in spec] == [1, 2] and (v.pivot_longer_spec(df, spec)).columns == ["id", "y_2", "k", "value"]
    long = mk([("a", "x", 1), ("b", "x", 2), ("a", "y", 3)], "id string, name string, value long")
    assert rows(long >> v.pivot_wider()) == [("a", 1, 3), ("b", 2, None)]
    assert rows(long >> v.pivot_wider(values_fill=0, names_prefix="n_"), "id", "n_y") == [("a", 3), ("b", 0)]
    two = mk([(1, "p", 1, 2), (1, "q", 3, 4)], "id long, k string, x long, y long")
    assert (two >> v.pivot_wider(names_from=_.k, values_from=_["x", "y"])).columns == ["id", "x_p", "x_q", "y_p", "y_q"]
    assert (two >> v.pivot_wider(names_from=_.k, values_from=_["x", "y"], names_vary="slowest", names_glue="{k}.{_value}")).columns == ["id", "p.x", "p.y", "q.x", "q.y"]
    assert (long >> v.arrange(-_.value) >> v.pivot_wider()).columns == ["id", "y", "x"]
    assert rows(long >> v.pivot_wider(id_cols=_.id, values_fn="count"), "id", "x") == [("a", 1), ("b", 1)]
    with pytest.raises(ValueError):
        v.build_longer_spec(df, _.x_1, names_to=["a", "b"])


def test_nest_unnest(mk):
    df = mk([("a", 1, 2.0), ("a", 2, None), ("b", 3, 1.0)], "g string, x long, y double")
    nested = df >> v.nest(-_.g)
    assert nested.columns == ["g", "data"] and rows(nested >> v.unnest("data")) == rows(df)
    assert (df >> v.group_by(_.g) >> v.nest(key="k")).columns == ["g", "k"]


def test_expand_complete(mk):
    df = mk([(1, "a", 8.0), (2, "a", 9.0), (2, "b", None)], "x long, y string, z double")
    assert len(rows(df >> v.expand(_.x, _.y))) == 4
    assert rows(df >> v.complete(_.x, _.y, fill={"z": 0.0})) == [(1, "a", 8.0), (1, "b", 0.0), (2, "a", 9.0), (2, "b", 0.0)]
    assert rows(df >> v.complete(_.x, _.y, fill={"z": 0.0}, explicit=False)) == [(1, "a", 8.0), (1, "b", 0.0), (2, "a", 9.0), (2, "b", None)]


def test_separate_extract_unite(mk):
    df = mk([("S1-E1",), ("S1-E2",)], "label string")
    assert rows(df >> v.separate(_.label, ["s", "e"])) == [("S1", "E1"), ("S1", "E2")]
    assert (df >> v.separate(_.label, ["s", "label"], remove=True)).columns == ["label", "s"]
    num = mk([("1-1",), ("2-a",)], "label string")
    assert dict((num >> v.separate(_.label, ["a", "b"], convert=True)).to_spark().dtypes) == {"a": "bigint", "b": "string"}
    with pytest.raises(ValueError):
        df >> v.separate(_.label, ["a", "b", "c"])
    assert rows(mk([("a-b-c",)], "x string") >> v.separate(_.x, ["p", "q"], extra="merge")) == [("a", "b-c")]
    assert rows(df >> v.extract(_.label, ["n"], r"E(?P<n>\d)", convert=True)) == [(1,), (2,)]
    with pytest.raises(ValueError):
        df >> v.extract(_.label, ["a", "b"], r"(\d)")
    two = mk([("s1", "e1"), ("s2", None)], "a string, b string")
    assert rows(two >> v.unite("c", _.a, "b")) == [(None,), ("s1_e1",)]
    with pytest.raises(ValueError):
        two >> v.unite("a", "b", "nope")


def test_names_repair():
    assert v.vec_as_names(["a", "a", "b"], "unique") == ["a___0", "a___1", "b"]
    assert v.vec_as_names(["a"], lambda x: [n + "!" for n in x]) == ["a!"]
    with pytest.raises(ValueError):
        v.vec_as_names(["a", "a"])


def test_factors(mk):
    df = mk([("a", 1), ("b", 2), ("b", 3), ("c", 9), (None, 5)], "f string, x long")
    assert v.levels(df >> v.arrange(-_.x) >> v.fct_inorder("f"), "f") == ["c", "b", "a"]
    assert v.levels(df >> v.fct_infreq(_.f), "f") == ["b", "a", "c"]
    assert v.levels(df >> v.fct_reorder("f", "x", "max", desc=True), "f") == ["c", "b", "a"]
    assert v.levels(df >> v.fct_infreq("f") >> v.fct_rev("f"), "f") == ["c", "a", "b"]
    assert rows(df >> v.fct_lump("f", n=1) >> v.count(_.f)) == [(None, 1), ("Other", 2), ("b", 2)]
    assert rows(df >> v.fct_lump("f", prop=0.3) >> v.distinct(_.f)) == [(None,), ("Other",), ("b",)]
    assert rows(df >> v.transmute(r=v.fct_recode(_.f, z="a"), c=v.fct_collapse(_.f, {"k": ["a", "b"]}, group_other="o"))) == [(None, None), ("b", "k"), ("b", "k"), ("c", "o"), ("z", "k")]
    with pytest.raises(ValueError):
        df >> v.mutate(c=v.fct_collapse(_.f, {"k": ["a"], "l": ["a"]}))
    coded = df >> v.fct_infreq("f") >> v.mutate(k=_.f.cat.codes, s=_.f.cat.remove_categories("b"), t=_.f.cat.rename_categories({"a": "A"}))
    assert rows(coded, "f", "k", "s", "t") == [(None, -1, None, None), ("a", 1, "a", "A"), ("b", 0, None, "b"), ("b", 0, None, "b"), ("c", 2, "c", "c")]
    assert v.levels(coded, "t") == ["b", "A", "c"] and v.levels(coded, "s") == ["a", "c"]


def test_user_functions(mk):
    @v.column_function("agg")
    def spread_of(c, x):
        return c.agg(__import__("pyspark.sql.functions", fromlist=["x"]).max(x)) - c.agg(__import__("pyspark.sql.functions", fromlist=["x"]).min(x))

    df = mk([(1, "a"), (5, "a"), (7, "b")], "x long, g string")
    assert rows(df >> v.group_by(_.g) >> v.summarize(s=spread_of(_.x))) == [("a", 4), ("b", 0)]
    assert rows(df >> v.group_by(_.g) >> v.mutate(s=spread_of(_.x)), "s") == [(0,), (4,), (4,)]


def test_sources_and_sinks(spark, mk, tmp_path):
    df = mk([(1, "a"), (2, "b")], "x long, g string")
    for kind in ("parquet", "json", "csv", "orc"):
        out = v.tbl(df) >> v.write_table(f"{tmp_path}/{kind}", kind, **({"header": True} if kind == "csv" else {}))
        assert rows(v.read_table(spark, f"{tmp_path}/{kind}", kind), "x", "g") == rows(out)
    assert isinstance(df >> v.collect(), pd.DataFrame)
    with pytest.raises(ValueError):
        v.read_table(spark, "x", "xlsx")
    with pytest.raises(KeyError):
        v.load_dataset(spark, "nope")


def test_show_query(mk, capfd):
    assert isinstance(mk([(1,)], "x long") >> v.filter(_.x > 0) >> v.show_query(), v.Tbl)


def test_filters_and_columns_reach_the_scan(spark):
    t = v.tbl(spark, "/root/testdata/sf0.001/lineitem.parquet") >> v.filter(_.l_quantity < 5) >> v.select(_.l_orderkey)
    plan = t.to_spark()._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,5" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_ungrouped_window_aggregates_use_no_single_partition(gx):
    plan = (gx >> v.mutate(m=_.x.mean())).to_spark()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastNestedLoopJoin" in plan


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00"), (3, "2024-01-01 02:00:00")], "x long, s string").selectExpr("x", "cast(s AS timestamp) AS ts")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    t = v.tbl(stream) >> v.watermark("ts", "10 minutes") >> v.filter(_.x > 0) >> v.group_by(w=v.time_window(_.ts, "1 hour")) >> v.summarize(n=v.n(_))
    q = t.to_spark().writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("hours").collect()) == [1, 2]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert (v.tbl(stream) >> v.mutate(y=_.x + 1) >> v.group_by(s=v.session_window(_.ts, "1 hour")) >> v.summarize(n=v.n(_))).df.isStreaming


def test_ungrouped_aggregates_share_one_pass(spark):
    import verbena as v
    from verbena import _

    t = v.tbl(spark, "/root/testdata/sf0.001/lineitem.parquet")
    q = _.l_quantity
    out = t >> v.mutate(a=q.mean(), b=_.l_tax.mean(), c=_.l_discount.std(), d=q.max(), e=q.min(), f=(q - q.mean()) / q.std())
    assert out.to_spark()._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    rows = out.to_spark().toPandas()
    assert abs(rows["f"].mean()) < 1e-9 and abs(rows["f"].std() - 1) < 1e-9
    nested = (t >> v.mutate(m=(q - q.mean()).abs().mean(), m2=_.m + q.max())).to_spark().toPandas()
    x = nested["l_quantity"]
    assert abs(nested["m"][0] - (x - x.mean()).abs().mean()) < 1e-9 and abs(nested["m2"][0] - nested["m"][0] - x.max()) < 1e-9


def test_whole_numbers_divide_exactly(spark):
    import verbena as v
    from verbena import _

    pairs = [(x, y) for x in (9007199254740993, -9007199254740993, 7, -7, 0) for y in (3, -3, 10)]
    got = (v.tbl(spark.createDataFrame(pairs, "x long, y long")) >> v.mutate(d=_.x // _.y, m=_.x % _.y)).to_spark().collect()
    assert all((r["d"], r["m"]) == divmod(r["x"], r["y"]) for r in got)
