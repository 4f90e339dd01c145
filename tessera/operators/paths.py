"""Cheapest paths over rasters in tiles: labels are corrected inside each tile, borders travel until none falls.

Places are vertices. ``enter`` gives, from a tile's planes, what entering a place from each of its neighbours costs, so one search
serves 8-connected pixels and the 4-connected corners between them. A round hands each tile the distances just outside it
where they fell, relaxes the tile by sweeps over whole rows, and keeps the borders that fell for the next round. A task holds one
tile and its halo at a time; each round is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import tiles
from tessera.operators.pixelwise import XY
from tessera.operators.seams import BLOCKED
from tessera.operators.tiles import SIDE, SIZE, TILE, _ints, _lists, _longs, _plane, _schema, _taken, _types
from tessera.storage import discard, materialize

#: No way, and no distance yet.
CLOSED, FAR = 1 << 50, 1 << 60
#: Where the neighbour is that a place is entered from, (dx, dy), in row order.
AROUND = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
Enter = Callable[[dict[str, np.ndarray]], list[np.ndarray]]


def pixels_entered(planes: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Entering a pixel costs at least 1 and its ``cost``, 1.4 times as much across a corner, truncated; blocked pixels are all but closed."""
    c = planes["cost"]
    straight = np.maximum(1, c) * np.where(c == BLOCKED, 65_536, 1)
    slanted = straight * 14 // 10
    return [slanted if dx and dy else straight for dx, dy in AROUND]


def corners_entered(planes: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Corners are entered along the four steps that ``up``, ``left``, ``right`` and ``down`` have the costs of."""
    names = {(0, -1): "up", (-1, 0): "left", (1, 0): "right", (0, 1): "down"}
    shut = np.full_like(planes["up"], CLOSED)
    return [planes[names[d]] if d in names else shut for d in AROUND]


def relax(d: np.ndarray, entered: list[np.ndarray]) -> np.ndarray:
    """Distances inside a halo of given ones, lowered until no step lowers any."""
    e = dict(zip(AROUND, (np.pad(c, 1, constant_values=CLOSED) for c in entered)))
    last = d.shape[0] - 1
    across = [(np.cumsum(e[-1, 0][y]), np.cumsum(e[1, 0][y][::-1])) for y in range(last + 1)]

    def row(y: int, of: int) -> None:
        near, dy = d[of], of - y
        np.minimum(d[y], near + e[0, dy][y], out=d[y])
        np.minimum(d[y, 1:], near[:-1] + e[-1, dy][y, 1:], out=d[y, 1:])
        np.minimum(d[y, :-1], near[1:] + e[1, dy][y, :-1], out=d[y, :-1])
        # along the row: the least of what lies before, by the sum of costs from there
        right, left = across[y]
        np.minimum(d[y], np.minimum.accumulate(d[y] - right) + right, out=d[y])
        np.minimum(d[y], (np.minimum.accumulate(d[y, ::-1] - left) + left)[::-1], out=d[y])

    while True:
        before = d.copy()
        for y in range(1, last + 1):
            row(y, y - 1)
        for y in range(last - 1, -1, -1):
            row(y, y + 1)
        if (d == before).all():
            return d


def _strip(d: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """The border of a tile that its neighbour at (dx, dy) sees."""
    pick = {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}
    return d[pick[dy], pick[dx]].ravel()


def _with_halo(d: np.ndarray, given: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """A tile inside the strips that its neighbours at ``AROUND[k]`` sent."""
    out = np.pad(d, 1, constant_values=FAR)
    pick = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
    for k, strip in given:
        dx, dy = AROUND[k]
        part = out[pick[dy], pick[dx]]
        part[...] = strip.reshape(part.shape)
    return out


_SENT = "array<struct<to:long,strip:array<long>>>"


def _sent(strips: list[list[tuple[int, np.ndarray]]]) -> pa.ListArray:
    flat = [s for row in strips for s in row]
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in strips])]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array([k for k, _ in flat], pa.int64()), _lists([v for _, v in flat], pa.int64())], names=["to", "strip"])
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def _messages(state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tx, ty, given): the strips that each tile gets, at most one from each neighbour; ``from`` counts in AROUND."""
    sent = state.select(*keys, *TILE, F.explode("sent").alias("s"))
    dx, dy = (F.element_at(F.array(*(F.lit(d[i]) for d in AROUND)), (F.col("s.to") + 1).cast("int")) for i in (0, 1))
    # seen from the neighbour, the sender lies the other way
    rows = sent.select(*keys, (F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), F.struct((F.lit(7).cast("long") - F.col("s.to")).alias("from"), F.col("s.strip").alias("strip")).alias("g"))
    return rows.groupBy(*keys, *TILE).agg(F.collect_list("g").alias("given"))


def _given(column: pa.ListArray, row: int) -> list[tuple[int, np.ndarray]]:
    parts = column[row].values
    if parts is None:
        return []
    return [(parts.field(0)[i].as_py(), _plane(parts.field(1), i)) for i in range(len(parts))]


def _stepper(keys: list[str], planes: list[str], enter: Enter, side: int, whole: bool) -> tiles.Run:
    """One round. ``whole`` only sends all borders, for a walk along the distances."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tiles.bounded(batches):
            sizes, dist, strips = _ints(b, [*TILE, *SIZE]), [], []
            for r, (tx, ty, w, h, _, _) in enumerate(sizes):
                shape = min(side, h - ty * side), min(side, w - tx * side)
                d = _plane(b.column("dist"), r).reshape(shape)
                given = _given(b.column("given"), r) if not whole else []
                new = d
                if given or (not whole and b.column("fresh")[r].as_py()):
                    new = relax(_with_halo(d, given), enter({p: _plane(b.column(p), r).reshape(shape) for p in planes}))[1:-1, 1:-1]
                out = []
                for k, (dx, dy) in enumerate(AROUND):
                    inside = 0 <= tx + dx <= (w - 1) // side and 0 <= ty + dy <= (h - 1) // side
                    first = not whole and b.column("fresh")[r].as_py() and (_strip(new, dx, dy) < FAR).any()
                    if inside and (whole or first or (_strip(new, dx, dy) < _strip(d, dx, dy)).any()):
                        out.append((k, _strip(new, dx, dy)))
                dist.append(new)
                strips.append(out)
            columns = [*_taken(b, keys, list(range(b.num_rows))), *_longs(sizes, 6), *(b.column(p) for p in planes), _lists(dist, pa.int64()), _sent(strips)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *TILE, *SIZE, *planes, "dist", "sent"])

    return run


def _state(df: DataFrame, keys: list[str], planes: list[str], enter: Enter, sources: DataFrame, side: int, scratch: list[str]) -> DataFrame:
    """Tiles of final distances from the nearest of ``sources`` (keys, x, y)."""
    spark = df.sparkSession
    marked = df.select(*keys, *XY, *planes).join(sources.select(*keys, *XY, F.lit(0).cast("long").alias("dist")).distinct(), [*keys, *XY], "left")
    packed = tiles.pack(marked.withColumn("dist", F.coalesce("dist", F.lit(FAR))), keys, [*planes, "dist"], side=side)
    schema = f"{_types(packed, keys)}, {_schema([*planes, 'dist'])}, sent {_SENT}"
    step = _stepper(keys, planes, enter, side, False)
    none = F.lit(None).cast("array<struct<from:long,strip:array<long>>>")
    kept: list[str] = []
    seeded = F.array_min("dist") < FAR
    state = materialize(packed.withColumns({"given": none, "fresh": seeded}).mapInArrow(step, schema), "distances", scratch=kept)
    while state.agg(F.sum(F.size("sent"))).first()[0]:
        last, kept = kept, []
        rows = state.drop("sent").join(_messages(state, keys), [*keys, *TILE], "left").withColumn("fresh", F.lit(False))
        state = materialize(rows.mapInArrow(step, schema), "distances", scratch=kept)
        discard(spark, last)
    scratch += kept
    return state


def distances(df: DataFrame, keys: list[str], planes: list[str], sources: DataFrame, enter: Enter = pixels_entered, side: int = SIDE) -> DataFrame:
    """(keys, x, y, d): what the cheapest way from the nearest source to each place costs; places that none reaches are left out."""
    scratch: list[str] = []
    state = _state(df, keys, planes, enter, sources, side, scratch)
    out = materialize(tiles.unpack(state, keys, ["dist"], side).filter(F.col("dist") < CLOSED).withColumnRenamed("dist", "d"), "distances")
    discard(df.sparkSession, scratch)
    return out


def _walker(keys: list[str], planes: list[str], enter: Enter, side: int) -> tiles.Run:
    """Follows falling distances from a place (x, y) through one tile; the last point may lie in the next tile."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tiles.bounded(batches):
            places, ends = [], []
            for r, (tx, ty, w, h, _, _) in enumerate(_ints(b, [*TILE, *SIZE])):
                shape = min(side, h - ty * side), min(side, w - tx * side)
                d = _with_halo(_plane(b.column("dist"), r).reshape(shape), _given(b.column("given"), r))
                entered = enter({p: _plane(b.column(p), r).reshape(shape) for p in planes})
                x, y, n = (b.column(c)[r].as_py() for c in ("x", "y", "n"))
                x, y, path = x - tx * side, y - ty * side, []
                done = False
                while 0 <= x < shape[1] and 0 <= y < shape[0]:
                    path.append((x + tx * side, y + ty * side))
                    here = d[y + 1, x + 1]
                    if here == 0 or here >= CLOSED:
                        done = True
                        break
                    x, y = next((x + dx, y + dy) for (dx, dy), e in zip(AROUND, entered) if d[y + 1 + dy, x + 1 + dx] + e[y, x] == here)
                places.append(path)
                ends.append((n + len(path), x + tx * side, y + ty * side, int(done)))
            path = [_lists([np.array([p[i] for p in row], np.int64) for row in places], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*_taken(b, [*keys, "n"], list(range(b.num_rows))), *path, *_longs(ends, 4)], names=[*keys, "n", "px", "py", "next", "x", "y", "done"])

    return run


def cheapest(df: DataFrame, keys: list[str], planes: list[str], ends: DataFrame, enter: Enter = pixels_entered, side: int = SIDE) -> DataFrame:
    """(keys, ord, x, y): one cheapest path for each row of ``ends`` (keys, x, y, x2, y2), both ends included; none where there is no way.

    The walk is a round for each tile that the longest path crosses.
    """
    spark, scratch = df.sparkSession, []
    state = _state(df, keys, planes, enter, ends.select(*keys, F.col("x2").alias("x"), F.col("y2").alias("y")), side, scratch)
    whole = state.drop("sent").mapInArrow(_stepper(keys, planes, enter, side, True), f"{_types(state, keys)}, {_schema([*planes, 'dist'])}, sent {_SENT}")
    whole = materialize(whole, "borders", scratch=scratch)
    ready = materialize(whole.drop("sent").join(_messages(whole, keys), [*keys, *TILE], "left"), "walked", scratch=scratch)
    heads = ends.select(*keys, "x", "y", F.lit(0).cast("long").alias("n"))
    schema = f"{_types(df, keys)}, n long, px array<long>, py array<long>, next long, x long, y long, done long"
    out = None
    while True:
        at = heads.withColumns({"tx": F.floor(F.col("x") / side).cast("long"), "ty": F.floor(F.col("y") / side).cast("long")})
        walked = materialize(ready.join(at, [*keys, *TILE]).mapInArrow(_walker(keys, planes, enter, side), schema), "walk", scratch=scratch)
        part = walked.select(*keys, "n", F.posexplode(F.arrays_zip("px", "py")).alias("i", "p")).select(*keys, (F.col("n") + F.col("i")).alias("ord"), F.col("p.px").alias("x"), F.col("p.py").alias("y"))
        out = part if out is None else out.unionByName(part)
        heads = walked.filter("done = 0").select(*keys, "x", "y", F.col("next").alias("n"))
        if heads.isEmpty():
            break
    reached = state.select(*keys, *TILE, *SIZE, "dist")
    start = tiles.unpack(reached, keys, ["dist"], side).join(ends.select(*keys, "x", "y"), [*keys, *XY]).filter(F.col("dist") < CLOSED).select(*keys)
    done = materialize(out.join(start, keys, "left_semi"), "paths")
    discard(spark, scratch)
    return done
