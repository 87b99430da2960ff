"""Equivalences that hold for any data, on random frames."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import verbena as v
from verbena import _

ROWS = st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=12)
CHECKS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(t):
    return sorted(map(tuple, t.to_spark().collect()), key=lambda r: tuple((x is not None, x) for x in r))


def frame(spark, data):
    return v.tbl(spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, g long, x long"))


@CHECKS
@given(data=ROWS)
def test_counts_agree(spark, data):
    t = frame(spark, data)
    assert rows(t >> v.count(_.g)) == rows(t >> v.group_by(_.g) >> v.summarize(n=v.n(_)))
    assert sum(r[1] for r in rows(t >> v.count(_.g))) == len(data)
    assert rows(t >> v.add_count(_.g) >> v.distinct(_.g, _.n)) == rows(t >> v.count(_.g))


@CHECKS
@given(data=ROWS)
def test_long_and_back(spark, data):
    t = frame(spark, data)
    assert rows(t >> v.pivot_longer(_.g, _.x) >> v.pivot_wider()) == rows(t)
    assert rows(t >> v.nest(-_.g) >> v.unnest() >> v.select(_.id, _.g, _.x)) == rows(t)


@CHECKS
@given(data=ROWS, other=ROWS)
def test_semi_and_anti_split_the_left(spark, data, other):
    a, b = frame(spark, data), frame(spark, other)
    assert rows(v.bind_rows(v.semi_join(a, b, "x"), v.anti_join(a, b, "x"))) == rows(a)
    assert rows(v.semi_join(a, b, "x")) == rows(v.inner_join(a, b >> v.distinct(_.x), "x"))


@CHECKS
@given(data=ROWS)
def test_group_minimum_both_ways(spark, data):
    t = frame(spark, data)
    windowed = t >> v.group_by(_.g) >> v.filter(_.x == _.x.min()) >> v.ungroup()
    joined = t >> v.inner_join(t >> v.group_by(_.g) >> v.summarize(m=_.x.min()), "g") >> v.filter(_.x == _.m) >> v.select(-_.m) >> v.select(_.id, _.g, _.x)
    assert rows(windowed) == rows(joined)
