"""Layer lists in one pass, and luminance rounded once."""

import pytest

from tessera.plans import pixel_queries
from tessera.sources import catalog


def plain(layers, spec):
    out = []
    for file in sorted({f for f, *_ in layers}):
        have = {n: w for f, n, w in layers if f == file}
        last, named = max(have), []
        for r in catalog.parse_indices(spec):
            end = lambda n, default: default if n is None else n if n > 0 else last + 1 + n  # noqa: B023, E731
            lo, hi = end(r.first, 1), end(r.last, last)
            if r.first is not None and r.first == r.last:
                part = [lo] if 1 <= lo <= last else []
            else:
                part = list(range(max(lo, 1), min(hi, last) + 1))
            named += part[::-1] if r.reverse else part
        out += [(file, pos, n, have[n]) for pos, n in enumerate(named) if n in have]
    return out


@pytest.mark.parametrize("spec", ["reverse 2..-1,1,-1", "_..3,2..2,5", "reverse -3.._:1:1", "9,-9,4..2,-2..-1"])
def test_layer_lists_take_one_pass(spark, spec):
    layers = [(f, n, 10 * f + n) for f in range(1, 7) for n in range(1, f + 1) if (f, n) != (6, 4)]
    got = catalog.select_indexed(spark.createDataFrame(layers, "file long, layer_no long, w long"), spec)
    assert sorted((r.file, r.pos, r.layer_no, r.w) for r in got.collect()) == sorted(plain(layers, spec))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_luminance_on_a_boundary_is_that_of_exact_weights(spark, monkeypatch):
    rows = [(1, 0, 0, 12, 210, 0), (1, 1, 0, 71, 180, 0), (1, 2, 0, 248, 90, 0), (1, 3, 0, 108, 161, 1)]
    df = spark.createDataFrame(rows, "image_id long, x long, y long, r long, g long, b long")
    monkeypatch.setattr(pixel_queries.fx, "rgb", lambda spark, sf: df)
    assert [r.v for r in pixel_queries.p20(None, None).collect()] == [64] * 4
