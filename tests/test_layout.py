import random

import pytest

from folioflow.operators import layout as L
from folioflow.operators import ordered


@pytest.fixture(params=[1 << 20, 0])
def way(request, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", request.param)


def test_limits_between_neighbours(spark, way):
    rng = random.Random(4)
    labels = [(1, i, float(rng.randint(0, 60)), float(rng.randint(0, 90)), 10.0) for i in range(150)]
    labels += [(2, 1, 5.0, 5.0, 2.0), (3, 1, None, 5.0, 2.0), (None, 9, 5.0, 5.0, 2.0)]
    pages = [(1, 0.0, 100.0), (2, 0.0, 100.0)]
    got = L.horizontal_limits(
        spark.createDataFrame(labels, "page long, label_id long, x double, y double, width double"),
        spark.createDataFrame(pages, "page long, page_left double, page_right double"),
    ).collect()
    assert len(got) == len(labels)
    found = {(r.page, r.label_id): (r.left_bound, r.right_bound) for r in got}
    assert found[2, 1] == (0.0, 100.0) and found[3, 1] == found[None, 9] == (None, None)
    for page, label, x, y, _ in labels[:150]:
        row = [b[2] for b in labels[:150] if b[1] != label and abs(b[3] - y) < 20]
        left, right = [x - v for v in row if v < x], [v - x for v in row if v >= x]
        before, after = min(left, default=None), min(right, default=None)
        want = (x + 5 - (after if before is None else before) / 2, x + 5 + (before if after is None else after) / 2)
        assert found[page, label] == want


def test_nearest_region(spark, way):
    rng = random.Random(6)
    labels = [(1, i, float(rng.randint(0, 600)), float(rng.randint(0, 700))) for i in range(120)] + [(2, 1, 5.0, 5.0), (1, 500, None, 1.0)]
    regions = []
    for i in range(60):
        left, top = float(rng.randint(0, 500)), float(rng.randint(0, 600))
        regions.append((1, i, left, left + rng.randint(30, 120), top, top + rng.randint(30, 90)))
    got = L.nearest_regions(
        spark.createDataFrame(labels, "page long, label_id long, center double, y double"),
        spark.createDataFrame(regions, "page long, region_no long, left double, right double, top double, bottom double"),
    ).collect()
    assert len(got) == len(labels)
    found = {(r.page, r.label_id): r.region_no for r in got}
    for page, label, c, y in labels:
        best = []
        for p, no, left, right, top, bottom in regions:
            if c is None or p != page or right - left < 40 or bottom - top < 40 or bottom > y + 12:
                continue
            aside = max(left - c, c - right, 0)
            if aside <= max(60, 1.5 * (right - left)):
                best.append((abs(y - bottom) + aside, no, bottom))
        want = min(best, default=None)
        assert found[page, label] == (want[1] if want and abs(y - want[2]) <= 160 else None)


def rows_kept(monkeypatch):
    """Counts the rows that a layout operator writes down."""
    kept = []

    def counted(df):
        kept.append(df.count())
        return ordered_settle(df)

    ordered_settle = L.settle
    monkeypatch.setattr(L, "settle", counted)
    return kept


def test_limits_keep_one_row_per_label(spark, monkeypatch):
    kept = rows_kept(monkeypatch)
    # several strips, rows across their edges, and a label that is there twice
    rng = random.Random(5)
    labels = [(i % 2, i, float(rng.randint(0, 300)), float(rng.randint(1240, 1330)), 10.0) for i in range(600)]
    pages = spark.createDataFrame([(0, 0.0, 100.0), (1, 0.0, 100.0)], "page long, page_left double, page_right double")
    table = spark.createDataFrame([*labels, labels[0]], "page long, label_id long, x double, y double, width double")
    got = L.horizontal_limits(table, pages).collect()
    assert len(got) == 601 and sum(kept) <= 2 * len(labels)
    found = {(r.page, r.label_id): (r.left_bound, r.right_bound) for r in got}
    for page, label, x, y, _ in labels:
        row = [b[2] for b in labels if b[0] == page and b[1] != label and abs(b[3] - y) < 20]
        left, right = [x - v for v in row if v < x], [v - x for v in row if v >= x]
        before, after = min(left, default=None), min(right, default=None)
        want = (x + 5 - (after if before is None else before) / 2, x + 5 + (before if after is None else after) / 2)
        assert found[page, label] == want


def test_regions_keep_one_row_per_place(spark, monkeypatch):
    kept = rows_kept(monkeypatch)
    rng = random.Random(7)
    labels = [(1, i, float(rng.randint(0, 600)), float(rng.randint(0, 700))) for i in range(400)]
    regions = []
    for i in range(300):
        left, top = float(rng.randint(0, 500)), float(rng.randint(0, 600))
        regions.append((1, i, left, left + rng.randint(30, 120), top, top + rng.randint(30, 90)))
    # labels of a page without regions, regions of no page, regions without labels
    more = [(2, 1, 5.0, 5.0), (None, 3, 5.0, 5.0)]
    other = [(None, 1, 0.0, 99.0, 0.0, 99.0), (3, 1, 0.0, 99.0, 0.0, 99.0)]
    got = L.nearest_regions(
        spark.createDataFrame(labels + more, "page long, label_id long, center double, y double"),
        spark.createDataFrame(regions + other, "page long, region_no long, left double, right double, top double, bottom double"),
    ).collect()
    assert sum(kept) <= len(labels) + len(regions) and len(got) == len(labels) + 2
    found = {(r.page, r.label_id): r.region_no for r in got}
    assert found[2, 1] is None and found[None, 3] is None
    for _, label, c, y in labels:
        best = []
        for _, no, left, right, top, bottom in regions:
            aside = max(left - c, c - right, 0)
            if right - left >= 40 and bottom - top >= 40 and bottom <= y + 12 and aside <= max(60, 1.5 * (right - left)):
                best.append((abs(y - bottom) + aside, no, bottom))
        want = min(best, default=None)
        assert found[1, label] == (want[1] if want and abs(y - want[2]) <= 160 else None)
