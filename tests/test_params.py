import pytest

from placebeat.params import Params


def test_defaults():
    p = Params()
    assert (p.cell_size_km, p.dense_city_threshold, p.window_duration, p.slide_duration) == (2.0, 0, "30 minutes", "10 minutes")
    assert (p.emerging_score_threshold, p.rating_spike_threshold, p.min_events, p.cluster_seed, p.latest_limit) == (1.5, 0.5, 5, 7, 200)


def test_from_nested_mapping():
    p = Params.from_mapping(
        {"dataset": {"review_path": "r", "limit": 25000}, "source": {"type": "kafka", "trigger_seconds": "9"},
         "geo": {"dense_city_threshold": 400}, "analytics": {"window_duration": "1 hour"}, "dashboard": None, "stream": {"batch_size": 1}}
    )
    assert (p.review_path, p.limit, p.source_type, p.trigger_seconds) == ("r", 25000, "kafka", 9)
    assert (p.dense_city_threshold, p.window_duration, p.slide_duration) == (400, "1 hour", "10 minutes")


def test_minimum_of_one_event():
    assert Params(min_events_for_hotspot=0).min_events == 1


@pytest.mark.parametrize(
    "bad", [{"window_duration": "1 month"}, {"slide_duration": "1 hour"}, {"cluster_by": ("state",)}]
)
def test_refused(bad):
    with pytest.raises(ValueError):
        Params(**bad)
