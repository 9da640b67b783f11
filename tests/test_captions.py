"""Components of a frame that share a number: one anchor whose band is all of theirs, as in the queries' SQL."""

import random

import pyarrow as pa

from framelane.operators import caption_bands, captions

COLUMNS = (
    "clip_id long, frame_index long, component_id long, x long, y long, width long, height long, area long, center_y double, "
    "roi_width long, roi_height long"
)


def components(spark, *places):
    """Components 60 x 10 at ``number, x, y`` in one frame of 1280 x 300."""
    return spark.createDataFrame([(1, 1, n, x, y, 60, 10, 100, y + 5.0, 1280, 300) for n, x, y in places], COLUMNS)


def test_places_of_one_number_make_one_band(spark):
    """Each place alone holds one component, too few for a box."""
    found = components(spark, (7, 0, 10), (7, 80, 29), (7, 160, 48))
    boxes = captions.cluster_caption_lines(found, 3, 60)
    assert [tuple(r)[2:] for r in boxes.collect()] == [(0, 7, 226, 61, 7, 0)]
    other = components(spark, (7, 0, 10), (8, 80, 29), (9, 160, 48))
    assert captions.cluster_caption_lines(other, 3, 60).count() == 0
    taken = captions.absorb_companions(found, boxes, 3)
    assert [tuple(r)[2:] for r in taken.collect()] == [(7, 0, 7, 226, 61, 0, 7, 66, 23)]


def test_a_component_given_twice_counts_for_both_anchors(spark):
    twice = captions.filter_text_components(components(spark, (5, 0, 10), (5, 0, 10)))
    assert twice.count() == 2
    assert captions.filter_text_components(components(spark, (5, 0, 10), (6, 0, 10))).count() == 0


def by_pairs(rows):
    """Text components by comparing each component of a frame with each other, as the SQL does; rows have passed the size gate."""
    inside = lambda a, b: a[0] == b[0] and abs(b[6] - a[6]) <= max(10.0, a[4] * 1.8)
    passing = []
    for a in rows:
        copies = sum(r[:2] == a[:2] and r[6] == a[6] and max(10.0, r[4] * 1.8) == max(10.0, a[4] * 1.8) for r in rows)
        band = [b for b in rows if inside(a, b)]
        wide = band and max(b[2] + b[3] for b in band) - min(b[2] for b in band) >= 57
        if wide and copies * len(band) >= 3 and copies * sum(b[5] for b in band) <= 30720:
            passing.append(a)
    alone = lambda r: r[3] >= 204 and 6 <= r[4] <= 48 and r[5] / (r[3] * r[4]) <= 0.72
    return [r for r in rows if alone(r) or any(inside(p, r) for p in passing)]


def random_components(seed, frames, most):
    """``frame, number, x, width, height, area, center_y``; centres that band edges meet, some null or not finite, some rows twice."""
    rng = random.Random(seed)
    rows = []
    for frame in range(frames):
        for _ in range(rng.randint(1, most)):
            height, number = rng.choice([5, 6, 7, 10, 13, 25]), rng.randint(0, 40)
            center = rng.choice([rng.randint(0, 160) / 10, rng.randint(0, 300) / 10 * 1.8, 2.7 * rng.randint(1, 60), rng.uniform(0, 290)])
            row = (frame, number, rng.randint(0, 1200), rng.choice([8, 20, 60, 210]), height, rng.randint(6, 300), center)
            rows += [row] * rng.choice([1, 1, 1, 2, 3])
    return rows + [(0, 90, 5, 210, 10, 300, float("nan")), (0, 91, 5, 20, 10, 60, float("nan")), (0, 92, 5, 20, 10, 60, float("inf"))]


def as_table(spark, rows):
    full = [(f % 3, f, n, x, 0, w, h, a, c, 1280, 300) for f, n, x, w, h, a, c in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(5)


def test_text_components_equal_comparing_all_pairs(spark):
    found = [(r.frame_index, r.component_id, r.x, r.width, r.height, r.area, r.center_y) for r in captions.filter_text_components(
        as_table(spark, random_components(3, 60, 14))
    ).collect()]
    want = by_pairs(random_components(3, 60, 14))
    assert sorted(map(str, found)) == sorted(map(str, want)) and len(want) < len(random_components(3, 60, 14))


def test_frames_longer_and_shorter_than_a_batch(spark):
    longer = [(15, *r[1:]) for r in random_components(6, 1, 300)]
    rows = sorted(random_components(5, 30, 20) + longer, key=lambda r: (r[0], str(r)))
    table = pa.table({"frame": [r[0] for r in rows], "n": list(range(len(rows)))})
    parts = list(caption_bands.whole_frames(iter(table.to_batches(max_chunksize=7)), ["frame"], 50))
    assert pa.concat_tables(parts).equals(table) and len(parts) > 3
    frames = [set(p.column("frame").to_pylist()) for p in parts]
    assert all(not a & b for i, a in enumerate(frames) for b in frames[:i])


def test_text_components_move_once_and_meet_in_no_join(spark):
    found = captions.filter_text_components(components(spark, (7, 0, 10)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
