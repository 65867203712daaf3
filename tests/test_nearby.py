import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seismark.operators.nearby import BoxTree, great_circle_km, points_near, quadtree_leaves, search_boxes


def brute(left, right, radius):
    out = set()
    for i, lat, lon in left:
        for j, lat_b, lon_b in right:
            if None not in (lat, lon) and -90 <= lat <= 90 and -180 <= lon <= 180 and great_circle_km(np.array([lon]), np.array([lat]), np.array([lon_b]), np.array([lat_b]))[0] <= radius:
                out.add((i, j))
    return out


def near(spark, left, right, radius):
    a = spark.createDataFrame(left, "id bigint, lat double, lon double")
    b = spark.createDataFrame(right, "id bigint, lat double, lon double")
    return [(r[0], r[1]) for r in points_near(a, "id", "lat", "lon", b, "id", "lat", "lon", radius).collect()]


def test_equals_brute_force_with_poles_date_line_and_bad_points(spark):
    rng = np.random.default_rng(3)
    left = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(400)]
    left += [(1000 + i, float(rng.uniform(88.5, 90)), float(rng.uniform(-180, 180))) for i in range(60)]
    left += [(2000 + i, float(rng.uniform(-5, 5)), float(s * rng.uniform(179, 180))) for i in range(40) for s in (-1, 1)]
    left += [(9001, None, 5.0), (9002, 91.0, 0.0), (9003, 0.0, 181.0), (9004, float("nan"), 0.0), (9005, 0.0, 0.0), (9005, 0.0, 0.0)]
    right = [(i, float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(100)]
    right += [(500, 89.9, 10.0), (501, 0.0, 179.99), (502, 0.0, -179.99), (503, 0.0, 0.2), (504, -90.0, 0.0), (505, 90.0, 7.0)]
    pairs = near(spark, left, right, 150.0)
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute([x for x in left if x[0] != 9004], right, 150.0)


def test_one_place_with_most_rows_and_empty_tables(spark):
    left = [(i, 10.0, 20.0) for i in range(3000)] + [(5000, 10.2, 20.0)]
    assert len(near(spark, left, [(1, 10.0, 20.1), (2, 50.0, 20.0)], 40.0)) == 3001
    assert near(spark, [], [(1, 0.0, 0.0)], 40.0) == [] and near(spark, [(1, 0.0, 0.0)], [], 40.0) == []


def test_leaves_tile_the_map():
    rng = np.random.default_rng(1)
    boxes, shares = quadtree_leaves(rng.normal(10, 5, 2000), rng.normal(20, 5, 2000), 1 / 50)
    area = ((boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])).sum()
    assert abs(area - 360 * 180) < 1e-6 and abs(shares.sum() - 1) < 1e-9 and len(boxes) > 10


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-180, 180), st.floats(-90, 90), st.floats(0, 30), st.floats(0, 30)), min_size=1, max_size=80), st.lists(st.tuples(st.floats(-180, 180), st.floats(-90, 90)), min_size=1, max_size=20))
def test_tree_finds_every_box(boxes, points):
    b = np.array([(x, y, x + w, y + h) for x, y, w, h in boxes])
    p = np.array(points)
    got = set(zip(*map(lambda v: v.tolist(), BoxTree(b).probe(p[:, 0], p[:, 1]))))
    assert got == {(i, j) for i, (x, y) in enumerate(points) for j in range(len(b)) if b[j, 0] <= x <= b[j, 2] and b[j, 1] <= y <= b[j, 3]}


def test_search_boxes_cover_the_circle():
    rng = np.random.default_rng(2)
    for _ in range(300):
        lon, lat = rng.uniform(-180, 180), rng.uniform(-90, 90)
        boxes = search_boxes(lon, lat, 40.0)
        other = np.column_stack([lon + rng.normal(0, 1, 50) / max(0.01, np.cos(np.radians(lat))), np.clip(lat + rng.normal(0, 0.3, 50), -90, 90)])
        other[:, 0] = (other[:, 0] + 180) % 360 - 180
        km = great_circle_km(np.full(50, lon), np.full(50, lat), other[:, 0], other[:, 1])
        for (x, y), d in zip(other, km):
            assert d > 40 or any(w <= x <= e and s <= y <= n for w, s, e, n in boxes)


def test_hot_places_on_both_sides_are_split(spark, monkeypatch):
    monkeypatch.setattr("seismark.operators.nearby.ROWS_PER_GROUP", 40)
    monkeypatch.setattr("seismark.operators.nearby.PAIRS_PER_GROUP", 500)
    left = [(i, 10.0, 20.0) for i in range(200)] + [(1000 + i, 10.0 + i / 50, 20.0) for i in range(50)]
    right = [(i, 10.0, 20.0) for i in range(150)] + [(1000 + i, 10.0, 20.0 + i / 50) for i in range(50)]
    pairs = near(spark, left, right, 30.0)
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(left, right, 30.0)


def test_only_unusable_points(spark):
    assert near(spark, [(1, None, None)], [(1, 0.0, 0.0)], 40.0) == []
