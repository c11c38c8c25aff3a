from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pytest
from conftest import by_id, spectra_of

from spectraloom.operators import classifiers, recipe
from spectraloom.operators.recipe import Step
from spectraloom.plans import review

STEPS = [Step("SNV"), Step("Mean center")]


def test_candidates_come_back_from_csv():
    plans = classifiers.planned([("r", STEPS)], 40, 7, classifiers.data_limits(10, 30, 50))
    table = pd.DataFrame([{"recipe": recipe.to_json(s), **p} for _, s, p in plans])
    back = pd.read_csv(io.StringIO(table.to_csv(index=False)), float_precision="round_trip")
    for (_, steps, params), (_, row) in zip(plans, back.iterrows()):
        got_steps, got = review.trial_candidate(row.to_dict())
        assert got_steps == steps and got["model"] == params["model"] and got["use_pca"] == params["use_pca"]
        assert got["pcs"] == (params["pcs"] if params["use_pca"] else 0)
        assert all(got[k] == v for k, v in params.items() if k != "pcs"), (got, params)
    with pytest.raises(ValueError):
        review.trial_candidate({"model": "Oracle", "recipe": "[]"})


def test_plan_covers_the_grid_then_draws_within_bounds():
    recipes = [("a", []), ("b", STEPS)]
    limits = classifiers.data_limits(25, 12, 6)
    plans = classifiers.planned(recipes, 200, 3, limits)
    assert {(n, p["model"]) for n, _, p in plans[:6]} == {(n, f) for n in "ab" for f in classifiers.FAMILIES}
    assert plans == classifiers.planned(recipes, 200, 3, limits) and plans != classifiers.planned(recipes, 200, 4, limits)
    pcs = {p["pcs"] for _, _, p in plans if p["model"] != "PLS-DA"}
    assert pcs == set(range(2, 7)) and {p["pls_components"] for _, _, p in plans if p["model"] == "PLS-DA"} == set(range(1, 7))
    assert all(0.01 <= p["C"] <= 100 for _, _, p in plans if p["model"] == "SVM")
    assert {p["depth"] for _, _, p in plans if p["model"] == "Random Forest"} == set(classifiers.FOREST_DEPTHS)


@pytest.mark.parametrize("model,use_pca", [("Random Forest", True), ("Random Forest", False), ("SVM", True), ("PLS-DA", False)])
def test_projection_matches_svd(spark, model, use_pca):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(18, 9)) * np.arange(1, 10) + np.arange(18)[:, None]
    s = spectra_of(spark, x, np.arange(400.0, 409.0))
    row = {"model": model, "use_pca": use_pca, "pcs": 4 if use_pca else None, "recipe": recipe.to_json(STEPS)}
    found = review.trial_projection(s, row)
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    z = z - z.mean(axis=0)
    if model == "SVM":
        z = z / z.std(axis=0)
    u, d, _ = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    got = np.array(by_id(found.scores).scores.tolist())
    assert got.shape == (18, 3) and np.allclose(np.abs(got), np.abs((u * d)[:, :3]))
    assert found.display_only is not use_pca and found.uses_model_pca is use_pca


def test_defaults():
    assert review.dataset_defaults(500, 64) == {"neighbors": 40, "min_distance": 0.15, "components": 20, "max_components": 25}
    assert review.dataset_defaults(4, 2)["components"] == 3 and review.dataset_defaults(59, 9)["min_distance"] == 0.05
