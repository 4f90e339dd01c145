"""What kernels hold at once is bounded, and entropy and collapse move tiles instead of a row for every tap."""

import numpy as np
import pyarrow as pa

from tessera.operators import tiles, windows
from tessera.plans import raster_queries, scene_queries

KEYS = ["image_id"]


def pixels(spark, images):
    rows = [(i, x, y, int(v) % 5, int(v) % 3, int(v) % 7, bool(v % 4)) for i, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "image_id long, x long, y long, r long, g long, b long, alpha boolean")


def test_batches_are_cut_to_bytes_and_keep_their_rows():
    one = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([[i] * 300 for i in range(3000)], pa.list_(pa.int64()))], names=["k", "v"])
    got = list(tiles.bounded([one, one.slice(0, 0)]))
    assert max(b.nbytes for b in got) <= 2 * tiles.AT_ONCE < one.nbytes
    assert pa.Table.from_batches(got).to_pylist() == one.to_pylist()
    assert got[3].column("v").offsets[0].as_py() == 0  # buffers of its own
    wide = pa.RecordBatch.from_arrays([pa.array([list(range(1 << 18))] * 3)], names=["v"])
    assert [b.num_rows for b in tiles.bounded([wide])] == [1, 1, 1]


def test_small_windows_equal_sliding_histograms():
    rnd = np.random.default_rng(5)
    for shape in ((3, 8, 8), (2, 3, 9), (2, 2, 5)):
        values, valid = rnd.integers(0, 4, shape), rnd.random(shape) < 0.7
        want = [windows.sliding_entropy(v, on, 1) for v, on in zip(values, valid)]
        assert np.allclose(windows.small_entropy(values, valid, 1), want, atol=1e-12)


def test_entropies_of_all_channels_take_one_exchange_of_tiles(spark):
    rnd = np.random.default_rng(6)
    df = pixels(spark, [rnd.integers(0, 200, (9, 7)), rnd.integers(0, 200, (2, 5)), rnd.integers(0, 200, (13, 11))])
    names = {c: f"e{c}" for c in "rgb"}
    for side in (4, 64):
        got = windows.local_entropies(df, KEYS, names, side=side)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
        found = sorted((r.image_id, r.x, r.y, *(round(r[n], 9) for n in names.values())) for r in got.collect())
        every = [windows.local_entropy(df, KEYS, 3, value=c, side=64).withColumnRenamed("entropy", n) for c, n in names.items()]
        want = every[0].join(every[1], [*KEYS, "x", "y"]).join(every[2], [*KEYS, "x", "y"])
        assert found == sorted((r.image_id, r.x, r.y, *(round(r[n], 9) for n in names.values())) for r in want.collect())
        assert len(found) == df.filter("alpha and x > 0 and y > 0 and (image_id = 0 and x < 6 and y < 8 or image_id = 2 and x < 10 and y < 12)").count()


def test_collapse_moves_tiles(spark):
    plan = raster_queries.m08(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_colour_scores_join_entropies_once(spark):
    plan = scene_queries.fuse_color_stack(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__er" in plan and "ln(cast(c" not in plan.lower()
