from cairn.plans.spec import Bounds, SearchSpec
from cairn.plans.urlstate import query_from_spec, spec_from_query


def test_unfit_values_fall_back():
    assert spec_from_query("sort=x&kind=y&page=-2&pageSize=7&lat=a&lon=1&from=2024-13-01&minLat=1") == SearchSpec(kind="all", center=(0.0, 0.0), limit=100)


def test_values_are_held_and_ordered():
    spec = spec_from_query("?kind=media&sort=distance&lat=99&lon=-200&minLat=50&maxLat=-95&minLon=10&maxLon=20&page=3&pageSize=50&from=2024-01-01&to=2024-01-01")
    assert spec.center == (90, -180) and spec.bounds == Bounds(-90, 10, 50, 20) and (spec.limit, spec.offset) == (50, 100)
    assert spec.end_ms - spec.start_ms == 86_399_999


def test_round_trip():
    spec = SearchSpec(kind="video", order="distance", center=(47.5, 8.123456), bounds=Bounds(-1, -2, 3, 4.5), limit=250, offset=500)
    assert spec_from_query(query_from_spec(spec)) == spec
    assert query_from_spec(SearchSpec(limit=100)) == ""
