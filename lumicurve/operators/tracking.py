"""Stars followed from frame to frame by place and light."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicurve.operators.match import cell_pairs


class Tracker:
    """Where the stars of one field were last, and how bright."""

    def __init__(self, ids: np.ndarray, place: np.ndarray, flux: np.ndarray, reach: float, flux_ratio: float, smoothing: float):
        self.ids, self.flux = ids, flux
        self.place = np.where(np.isfinite(place).all(axis=1)[:, None], place, np.nan)
        self.reach, self.flux_ratio, self.smoothing = reach, flux_ratio, smoothing

    def follow(self, place: np.ndarray, flux: np.ndarray) -> np.ndarray:
        """Take in one frame's sources: the source of each star, or -1 where it is lost.

        A source is a star's candidate if it is closer than ``reach`` to the
        star's last place and their light differs by no more than the ratio.
        Pairs are taken nearest first (then by star, then by source), each star
        and each source once. A lost star moves by the median of the others'
        moves, so that it is looked for where its field has gone.
        """
        mine = np.full(len(self.ids), -1)
        known = np.flatnonzero(np.isfinite(self.place).all(axis=1))
        seen = np.flatnonzero(np.isfinite(place).all(axis=1) & np.isfinite(flux) & (flux > 0))
        if len(known) and len(seen):
            i, j = cell_pairs(self.place[known], place[seen], self.reach)
            i, j = known[i], seen[j]
            apart = np.hypot(*(self.place[i] - place[j]).T)
            like = np.abs(np.log(flux[j]) - np.log(self.flux[i])) <= np.log(self.flux_ratio)
            near = (apart < self.reach) & (like | ~(self.flux[i] > 0))
            i, j, apart = i[near], j[near], apart[near]
            used = np.zeros(len(place), bool)
            for k in np.lexsort((j, i, apart)).tolist():
                if mine[i[k]] < 0 and not used[j[k]]:
                    mine[i[k]], used[j[k]] = j[k], True
        found = np.flatnonzero(mine >= 0)
        shift = np.median(place[mine[found]] - self.place[found], axis=0) if len(found) else np.zeros(2)
        self.place = self.place + shift
        self.place[found] = place[mine[found]]
        fresh = flux[mine[found]]
        old = self.flux[found]
        self.flux[found] = np.where(old > 0, old + self.smoothing * (fresh - old), fresh)
        return mine


def track_stars(stars: DataFrame, sources: DataFrame, field: str, reach: float = 6.0, flux_ratio: float = 2.0, smoothing: float = 0.5) -> DataFrame:
    """(field, frame, star, x, y, flux, found): where each star is in each frame.

    ``stars``: field, star, x, y, flux, where they are before the first frame;
    ``sources``: field, frame, x, y, flux, what was found in each frame. Frames
    come in order; each star looks for a source near its last place that is as
    bright as it was (``Tracker``), so stars that cross keep apart by their
    light. A star without one is lost in that frame: found is false, flux null,
    its place the one it is looked for at next. A star's light follows its
    sources by ``smoothing``; a star of unknown or no light takes any source.

    Each field is a stream of its stars and then its frames in order, of which
    one frame is held at a time. Sources with a null place or no light are
    nobody's; a frame without rows does not exist; sources of a field without
    stars give nothing; a star without a place is never found. Ids are unique
    in a field.
    """
    columns = [field, "_frame", "_star", "x", "y", "flux"]
    number = lambda c: F.col(c).cast("double").alias(c)
    head = stars.select(field, F.lit(None).cast("long").alias("_frame"), F.col("star").cast("long").alias("_star"), number("x"), number("y"), number("flux"))
    rest = sources.where("frame IS NOT NULL").select(field, F.col("frame").cast("long").alias("_frame"), F.lit(None).cast("long").alias("_star"), number("x"), number("y"), number("flux"))
    dealt = head.unionByName(rest).repartition(field).sortWithinPartitions(field, F.asc_nulls_first("_frame"), "_star", "x", "y", "flux")
    names = [field, "frame", "star", "x", "y", "flux", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the frame that is being read
        key: tuple | None = None
        tracker: Tracker | None = None
        kind = None

        def done() -> pa.RecordBatch | None:
            nonlocal tracker
            if key is None:
                return None
            t = pa.Table.from_batches(held)
            xy = np.column_stack([t.column(c).to_numpy() for c in ("x", "y")]).astype(float)
            flux = t.column("flux").to_numpy().astype(float)
            if key[1] is None:
                tracker = Tracker(t.column("_star").to_numpy(), xy, flux, reach, flux_ratio, smoothing)
                return None
            if tracker is None:
                return None
            mine = tracker.follow(xy, flux)
            found, n = mine >= 0, len(mine)
            light = pa.array(np.where(found, flux[mine] if len(flux) else 0.0, 0.0), mask=~found)
            place = [pa.array(tracker.place[:, k], mask=~np.isfinite(tracker.place[:, k])) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, kind), pa.array([key[1]] * n, pa.int64()), pa.array(tracker.ids, pa.int64()), *place, light, pa.array(found)], names=names)

        for b in batches:
            kind = b.column(0).type
            fields, frames = b.column(0).to_pylist(), b.column(1).to_pylist()
            start = 0
            for k in range(1, len(fields) + 1):
                if k < len(fields) and (fields[k], frames[k]) == (fields[start], frames[start]):
                    continue
                own = (fields[start], frames[start])
                if own != key:
                    out = done()
                    if out is not None:
                        yield out
                    if key is None or own[0] != key[0]:
                        tracker = None
                    held, key = [], own
                held.append(b.slice(start, k - start))
                start = k
        out = done()
        if out is not None:
            yield out

    schema = f"`{field}` {stars.schema[field].dataType.simpleString()}, frame long, star long, x double, y double, flux double, found boolean"
    return dealt.select(columns).mapInArrow(run, schema)
