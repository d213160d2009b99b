import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quotaforge.functions import expr as E
from quotaforge.operators import audit, choose, evaluate, tables
from quotaforge.plans.registry import ORACLE_SQL, QUERIES


def test_group_audit_matches_known_shares(spark):
    rows = spark.createDataFrame([("A", True), ("A", False), ("B", True), ("B", True)], "g string, selected boolean")
    found = {r["group"]: r for r in audit.group_audit(rows, ["g"]).collect()}
    assert found["A"]["pool_share"] == 0.5
    assert found["A"]["selected_share"] == pytest.approx(1 / 3)
    assert found["A"]["share_error"] == pytest.approx(0)
    summary = audit.shift_summary(audit.group_audit(rows, ["g"])).first()
    assert summary["tv"] == pytest.approx(1 / 6)
    assert summary["max_propensity_ratio"] == pytest.approx(2.0)


def test_zero_propensity_groups_are_left_out_of_the_ratio(spark):
    rows = spark.createDataFrame([("A", True), ("A", False), ("B", True), ("B", True), ("C", False)], "g string, selected boolean")
    assert audit.shift_summary(audit.group_audit(rows, ["g"])).first()["max_propensity_ratio"] == pytest.approx(2.0)


def test_top_budget_breaks_ties_by_id_string(spark):
    rows = spark.createDataFrame([(9, 1.0), (10, 1.0), (2, 3.0)], "id long, s double")
    assert [r["id"] for r in choose.top_budget(rows, "s", "id", 2).collect()] == [2, 10]


def test_top_budget_narrows_large_pools(spark, monkeypatch):
    monkeypatch.setattr(choose, "SORTED", 50)
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 1000).cast("double").alias("s"))
    got = {r["id"] for r in choose.top_budget(rows, "s", "id", 30).collect()}
    want = sorted(range(5000), key=lambda k: (-(k * 7919 % 1000), str(k)))[:30]
    assert got == set(want)


def test_rank_normalised(spark):
    rows = spark.createDataFrame([("a", 10.0), ("b", 30.0), ("c", 20.0)], "id string, s double")
    assert {r["id"]: r["utility"] for r in choose.rank_normalised(rows, "s", "id").collect()} == {"a": 0.0, "b": 1.0, "c": 0.5}


def test_constrained_selection_keeps_shares_and_reports_infeasible(spark):
    rows = spark.createDataFrame([("a0", 1.0, "A"), ("a1", 0.9, "A"), ("b0", 0.2, "B"), ("b1", 0.1, "B")], "id string, u double, g string")
    assert {r["id"] for r in choose.constrained(rows, "u", "id", "g", 2, 0.0).collect()} == {"a0", "b0"}
    assert {r["id"] for r in choose.constrained(rows, "u", "id", "g", 2, 0.5).collect()} == {"a0", "a1"}
    with pytest.raises(ValueError):
        choose.constrained(rows, "u", "id", "g", 1, 0.0)
    trace = [(r["slack"], r["status"]) for r in choose.frontier(rows, "u", "id", "g", 2, [0.5, 0.0], loss=0.3).collect()]
    assert trace == [(0.0, "feasible"), (0.5, "chosen")]


def test_scores(spark):
    row = spark.createDataFrame([([0.7, 0.2, 0.1],)], "p array<double>").select(
        E.entropy(F.col("p")).alias("h"), E.margin(F.col("p")).alias("m"), E.reward_margin(F.lit(0.0)).alias("r"), E.dpo_loss(F.lit(1.0), F.lit(1.0), 0.1).alias("d")
    )
    got = row.first()
    assert got["h"] == pytest.approx(-sum(x * math.log(x) for x in (0.7, 0.2, 0.1)))
    assert got["m"] == pytest.approx(0.5)
    assert got["r"] == pytest.approx(1.0)
    assert got["d"] == pytest.approx(math.log(2))


def test_length_controlled_win(spark):
    rows = spark.createDataFrame([("short", 1.0), ("short", 0.0), ("long", 1.0)], "bin string, win double")
    got = evaluate.length_controlled_win(rows, "win", "bin").first()
    assert (got["raw_win_rate"], got["length_controlled_win_rate"]) == (pytest.approx(2 / 3), pytest.approx(0.75))


def test_exact_cover_join_refuses_gaps(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    right = spark.createDataFrame([(1, "z")], "id int, a string")
    with pytest.raises(ValueError):
        tables.exact_cover_join(left, right, "id")
    assert tables.exact_cover_join(left.filter("id = 1"), right, "id").first()["a"] == "z"


def test_hidden_fields_are_found_and_dropped(spark):
    rows = spark.createDataFrame([(1, 0)], "id int, label int")
    with pytest.raises(ValueError):
        tables.assert_safe(rows)
    assert tables.safe_view(rows).columns == ["id"]


def plain(value):
    """A value as text, numbers rounded alike whatever engine made them."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_registered_queries_match_their_sql(spark, name):
    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{where}/{t}.parquet'")
    got, want = QUERIES[name](spark, where), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
