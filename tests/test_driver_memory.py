"""What grows with the data neither passes through the driver nor is worked out twice."""

from junctura.operators import resampling as B
from junctura.plans import names as N


def test_draws_meet_the_positives_by_a_shuffle(spark):
    df = spark.createDataFrame([(i, i % 2, i) for i in range(40)], "site_id bigint, hit int, ra bigint")
    draws = B.draws_of_positives(df, "site_id", "hit", 3, ["ra"])
    plan = draws._jdf.queryExecution().optimizedPlan().toString() + draws._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    rows = draws.collect()
    assert len(rows) == 60 and {r.n_pos for r in rows} == {20} and all(r.site_id % 2 for r in rows)


def test_relabelled_points_are_matched_once(spark, monkeypatch):
    staged = []

    def stage(df, name="stage"):
        staged.append(name)
        return real(df, name)
    real = N.stage
    monkeypatch.setattr(N, "stage", stage)
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0)], "site_id bigint, x double, y double")
    nodes = spark.createDataFrame([(10, 1.0, 0.0, 1.0, 0.0), (11, 5.0, 0.0, 5.0, 0.0)], "node bigint, x double, y double, nx double, ny double")
    edges = spark.createDataFrame([(10, 12, ["Oak St"], None, ["residential"]), (11, 13, ["Elm St"], None, ["residential"])],
                                  "src bigint, dst bigint, name array<string>, service array<string>, highway array<string>")
    got = {r.site_id: (r.status, r.label, r.members) for r in N.relabel_points(points, nodes, edges, 60.0, 40.0).collect()}
    assert got == {1: ("ok", "Elm St & Oak St", 2), 2: ("no_match", None, None)}
    assert staged == ["matched", "members"]
