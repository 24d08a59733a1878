"""The boosted trees fit the whole history matrix, not the planted column alone."""

import os

import pytest

from junctura import catalog
from junctura.catalog import q_models
from junctura.plans import models as M

DIR = "/root/testdata/sf0.001"
catalog.load_all()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="bundled tables absent")
@pytest.mark.parametrize("name", ["m3_boosted_binary"])
def test_trees_see_every_history_feature(spark, monkeypatch, name):
    seen = []
    real = M._pipe

    def pipe(features, *a, **k):
        seen.append(set(features))
        return real(features, *a, **k)
    monkeypatch.setattr(M, "_pipe", pipe)
    out = catalog.QUERIES[name](spark, DIR)
    assert seen and all(set(q_models.CRASH) < f for f in seen)
    assert out.where("crashes_feat is not null").count() > 0 and " cand AS" in catalog.SQL[name]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="bundled tables absent")
def test_forest_scores_every_candidate_from_the_history_matrix(spark, monkeypatch):
    seen = []
    real = M._pipe

    def pipe(features, *a, **k):
        seen.append(list(features))
        return real(features, *a, **k)
    monkeypatch.setattr(M, "_pipe", pipe)
    out = catalog.QUERIES["m15_random_forest"](spark, DIR)
    assert seen.count(q_models.CRASH) == 3  # one fit a fold
    want = q_models.matrix(spark, DIR).count()
    assert want > 0 and out.where("crashes_feat is not null and history_scored").count() == want
