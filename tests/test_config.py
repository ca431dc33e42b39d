import pytest

from cellarflow.config import ConfigError, check_weights, load_features, parse_features, parse_job, positive, substitute_env, unit
from cellarflow.plans.pipeline import run_plan

GOOD = """
quantity_scaled_events = ["ordered"]
item_availability_filters = ["on_tap"]
boost_overfetch_factor = 2
[event_weights]
ordered = 6.5
looked = 0.25
[event_caps]
looked = 3
[[user_features]]
column = "hops"
type = "list"
[[boost]]
name = "local"
item_column = "local"
kind = "boolean"
factor = 3
[blending]
enabled = true
curve = "linear"
popular_share = 0.35
"""


def test_toml(tmp_path):
    p = tmp_path / "f.toml"
    p.write_text(GOOD)
    c = load_features(str(p))
    assert c.event_weights == {"ordered": 6.5, "looked": 0.25} and c.event_caps == {"looked": 3} and c.quantity_scaled == ("ordered",)
    assert c.boosts[0].factor == 3 and c.blending.curve == "linear" and c.blending.popular_share == 0.35 and c.boost_overfetch == 2


@pytest.mark.parametrize("bad", [
    {}, {"event_weights": {"a": 1}, "boost": [{"x": 1}], "boosts": [{"x": 1}]}, {"event_weights": {"a": 1}, "event_caps": {"a": 0}},
    {"event_weights": {"a": 1}, "user_features": [{"column": "x", "type": "odd"}]}, {"event_weights": {"a": 1}, "blending": {"curve": "odd"}},
    {"event_weights": {"a": 1}, "blending": {"popular_share": 2}}, {"event_weights": {"a": 1}, "boost": [{"item_column": "x", "kind": "value_map"}]},
    {"event_weights": {"a": 1}, "boost": [{"item_column": "x", "kind": "odd"}]}, {"event_weights": {"a": 1}, "boost": [{"kind": "boolean", "factor": 1}]},
])
def test_bad_features(bad):
    with pytest.raises(ConfigError):
        parse_features(bad)


def test_job():
    j = parse_job({"job": {"models": ["popular", "latest"], "model_weights": {"popular": 1}}})
    assert j.models == ("popular", "latest") and j.model_weights == {"popular": 1.0} and not j.automl
    a = parse_job({"job": {"automl": {"enabled": True, "n_splits": 3, "test_days": 5, "primary_metric": "NDCG", "candidates": [{"models": ["latest"]}]}}})
    assert (a.automl, a.folds, a.fold_days, a.primary_metric, a.candidates) == (True, 3, 5, "NDCG", ({"models": ["latest"]},))
    for bad in ({"models": ["odd"]}, {"top_k": 0}, {"rrf_k": -1}, {"model_weights": {"odd": 1}}, {"top_k": True}, {"top_k": 2.5}, {"automl": {"candidates": []}}, {"automl": {"n_splits": 0}}):
        with pytest.raises(ConfigError):
            parse_job({"job": bad})


def test_numbers():
    assert positive("x", 3, int) == 3 and unit("x", 1) == 1.0
    for bad in (0, -1, True, "1", None):
        with pytest.raises(ConfigError):
            positive("x", bad)
    with pytest.raises(ConfigError):
        check_weights({"a": -1}, ("a",))


def test_environment():
    assert substitute_env({"a": ["x${A}y", "$${A}", 1]}, {"A": "1"}) == {"a": ["x1y", "${A}", 1]}
    with pytest.raises(ConfigError):
        substitute_env("${NOPE}", {})


def test_run_plan():
    plan = lambda m, c=False, b=False: run_plan(m, content_fallback=c, blending=b)
    assert plan(["collaborative", "popular"], c=True) == ["collaborative", "content_fallback", "popular"]
    assert plan(["collaborative"], c=True) == ["collaborative", "content_fallback"]
    assert plan(["content_fallback", "popular"]) == ["popular"]
    assert plan(["item_based", "latest"], b=True) == ["item_based", "popular"]
    for bad in (["content_fallback"], ["odd"], []):
        with pytest.raises(ConfigError):
            plan(bad)
