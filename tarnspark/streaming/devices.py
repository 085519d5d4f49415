"""Per-device state over feeds of fixes, transfers and headings, on streams (state store) and on tables alike.

Rows of one device are taken in event-time order within a micro-batch. State is a few numbers per device. On a stream with a
watermark on the time column it is given up when the watermark has passed the device's last row by ``TTL_MS``; without a
watermark it stays. On tables routes and headings are windows over the device's
rows. A transfer rate builds on the one before, but each sample only takes it to ``a x + b``: a device's rows are cut into
chunks of time, each chunk is such a map as well, and a scan over the chunks tells each the rate that it starts from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tarnspark.functions.geo import EARTH_M, haversine_m
from tarnspark.operators.lines import DEGREE_M
from tarnspark.scratch import stored

TTL_MS = 24 * 3600 * 1000
#: Vertices of lines that are measured at once.
VERTICES_AT_ONCE = 1 << 20
Core = Callable[[tuple | None, pd.DataFrame], tuple[tuple | None, pd.DataFrame]]


class Keyed(StatefulProcessor):
    """A device's state as a value in the store: rows of a batch go through ``core`` in time order, a timer ends what is idle."""

    def __init__(self, core: Core, state: str, ts: str, expires: bool) -> None:
        self.core, self.form, self.ts, self.expires, self.ttl = core, state, ts, expires, TTL_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("device", self.form)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.ts, kind="stable")
        after, found = self.core(self.state.get() if self.state.exists() else None, batch)
        if after is not None:
            self.state.update(tuple(after))
            if self.expires:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                last = int(pd.Timestamp(batch[self.ts].iloc[-1]).timestamp() * 1000)
                self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.ttl)
        yield found

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stateful(df: DataFrame, keys: list[str], core: Core, out: str, state: str, ts: str = "ts") -> DataFrame:
    """Run ``core(state, rows in time order) -> (state, rows)`` per key of a stream, with state kept between micro-batches.

    Where the session keeps state in RocksDB, as a store of many devices should, state is a value of ``transformWithState``
    with a timer; another store has it as group state with a timeout.
    """
    expires = "spark.watermarkDelayMs" in (df.schema[ts].metadata or {})
    if "RocksDB" in df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        return df.groupBy(*keys).transformWithStateInPandas(Keyed(core, state, ts, expires), out, "Append", "EventTime" if expires else "None")

    def step(_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(ts, kind="stable")
        after, found = core(held.get if held.exists else None, rows)
        if after is not None:
            held.update(after)
            if expires:
                last = int(pd.Timestamp(rows[ts].iloc[-1]).timestamp() * 1000)
                held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs()) + TTL_MS)
        yield found

    return df.groupBy(*keys).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout if expires else GroupStateTimeout.NoTimeout)


def nearest_expr(coords: Column, lng: Column, lat: Column) -> Column:
    """``struct<distance_m, along_m>`` of the closest place on an array of <lng, lat>, in the plane that touches at the point.

    A fold over the array, so it also runs on streams.
    """
    scale = F.cos(F.radians(lat)) * DEGREE_M
    x = lambda p: (p["lng"] - lng) * scale
    y = lambda p: (p["lat"] - lat) * DEGREE_M
    start = F.struct(F.lit(None).cast("double").alias("d"), F.lit(0.0).alias("along"), F.lit(0.0).alias("gone"))

    def fold(acc: Column, i: Column) -> Column:
        p, q = F.get(coords, i), F.get(coords, i + 1)
        dx, dy = x(q) - x(p), y(q) - y(p)
        n = F.hypot(dx, dy)
        t = F.when(n == 0, 0.0).otherwise(F.least(F.greatest(-(x(p) * dx + y(p) * dy) / (n * n), F.lit(0.0)), F.lit(1.0)))
        d = F.hypot(x(p) + dx * t, y(p) + dy * t)
        better = acc["d"].isNull() | (d < acc["d"])
        return F.struct(
            F.when(better, d).otherwise(acc["d"]).alias("d"), F.when(better, acc["gone"] + n * t).otherwise(acc["along"]).alias("along"), (acc["gone"] + n).alias("gone")
        )

    walk = F.aggregate(F.sequence(F.lit(0), F.size(coords) - 2), start, fold)
    lone = F.element_at(coords, 1)
    return F.when(F.size(coords) >= 2, F.struct(walk["d"].alias("distance_m"), walk["along"].alias("along_m"))).when(
        F.size(coords) == 1, F.struct(haversine_m(lone["lng"], lone["lat"], lng, lat).alias("distance_m"), F.lit(0.0).alias("along_m"))
    )


def length_expr(coords: Column) -> Column:
    step = lambda acc, i: acc + haversine_m(F.get(coords, i)["lng"], F.get(coords, i)["lat"], F.get(coords, i + 1)["lng"], F.get(coords, i + 1)["lat"])
    return F.when(F.size(coords) >= 2, F.aggregate(F.sequence(F.lit(0), F.size(coords) - 2), F.lit(0.0), step)).otherwise(0.0)


def _along(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The closest place of each row's own line, as ``nearest_expr`` tells it: all segments of a batch at once."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            upto = np.cumsum(pc.list_value_length(whole.column("coords")).to_numpy(zero_copy_only=False)) // VERTICES_AT_ONCE
            cuts = np.flatnonzero(np.diff(upto)) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, whole.num_rows).tolist()):
                yield whole.slice(a, b - a)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            lng, lat = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("lng", "lat"))
            coords = batch.column("coords")
            n, points = pc.list_value_length(coords).to_numpy(zero_copy_only=False), coords.flatten()
            x, y = (pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(float) for c in ("lng", "lat"))
            first = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n)), np.maximum(n - 1, 1))  # a line of one vertex is a segment without length
            k = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(n - 1, 1)) - np.maximum(n - 1, 1), np.maximum(n - 1, 1))
            a = first[of] + k
            b = np.where(n[of] > 1, a + 1, a)
            scale = np.cos(np.radians(lat[of])) * DEGREE_M
            ax, ay = (x[a] - lng[of]) * scale, (y[a] - lat[of]) * DEGREE_M
            dx, dy = (x[b] - lng[of]) * scale - ax, (y[b] - lat[of]) * DEGREE_M - ay
            size = np.hypot(dx, dy)
            t = np.clip(np.divide(-(ax * dx + ay * dy), size * size, out=np.zeros(len(of)), where=size != 0), 0, 1)
            away = np.hypot(ax + dx * t, ay + dy * t)
            best = np.lexsort((k, away, of))[np.cumsum(np.maximum(n - 1, 1)) - np.maximum(n - 1, 1)]
            gone = np.cumsum(np.nan_to_num(size)) - np.nan_to_num(size)
            along = gone[best] - gone[best - k[best]] + size[best] * t[best]
            lone = n == 1
            h = np.sin(np.radians(y[a[best]] - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(y[a[best]])) * np.sin(np.radians(x[a[best]] - lng) / 2) ** 2
            off = np.where(lone, 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1))), away[best])
            total = batch.column("total").to_numpy(zero_copy_only=False).astype(float)
            told = lambda v: pa.array(v, mask=np.isnan(v))
            found = [*(batch.column(c) for c in ("device", "route_id", "ts")), told(off), told(np.fmin(along, total)), batch.column("total")]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(found, schema)], schema=schema)

    return placed


def _placed(fixes: DataFrame, lines: DataFrame) -> DataFrame:
    """Each fix of a table with how far it is from its route and how far along: device, route_id, ts, off_m, along_m, total."""
    met = fixes.join(lines.where(F.size("coords") > 0), "route_id").select("device", "route_id", "ts", "lng", "lat", "coords", "total")
    kinds = dict(met.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in ("device", "route_id", "ts")) + ", off_m double, along_m double, total double"
    return met.mapInArrow(_along(to_arrow_schema(T.StructType.fromDDL(out))), out)


def follow_route(fixes: DataFrame, routes: DataFrame, off_m: float = 60.0, rejoin_m: float = 30.0) -> DataFrame:
    """How each fix (device, route_id, ts, lng, lat) stands to its route (route_id, coords); fixes without a route go.

    A device is off its route beyond ``off_m`` and back on it within ``rejoin_m`` (never over ``off_m``). State is per device
    and route, so a new route starts afresh.
    """
    back = min(rejoin_m, off_m)
    lines = routes.select("route_id", "coords", length_expr(F.col("coords")).alias("total"))
    if fixes.isStreaming:
        met = fixes.join(lines, "route_id").withColumn("n", nearest_expr(F.col("coords"), F.col("lng"), F.col("lat"))).where("n is not null")
        flat = met.select("device", "route_id", "ts", F.col("n.distance_m").alias("off_m"), F.least("n.along_m", "total").alias("along_m"), "total")
    else:
        flat = _placed(fixes, lines)

    left, share = F.greatest(F.col("total") - F.col("along_m"), F.lit(0.0)), F.when(F.col("total") > 0, F.col("along_m") / F.col("total")).otherwise(0.0)
    if not flat.isStreaming:
        # The last fix that decides: beyond off_m, or back within the rejoin distance.
        told = F.when(F.col("off_m") > off_m, True).when(F.col("off_m") <= back, False)
        w = Window.partitionBy("device", "route_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        is_off = F.coalesce(F.last(told, ignorenulls=True).over(w), F.lit(False))
        return flat.select("device", "route_id", "ts", "off_m", is_off.alias("is_off"), "along_m", left.alias("remaining_m"), share.alias("fraction"))

    def core(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        off, flags = bool(state[0]) if state else False, []
        for d in rows["off_m"]:
            off = d > back if off else d > off_m
            flags.append(off)
        left = (rows["total"] - rows["along_m"]).clip(lower=0)
        share = (rows["along_m"] / rows["total"]).where(rows["total"] > 0, 0.0)
        out = rows[["device", "route_id", "ts", "off_m"]].assign(is_off=flags, along_m=rows["along_m"], remaining_m=left, fraction=share)
        return (off,), out

    kinds = dict(flat.dtypes)
    out = f"device {kinds['device']}, route_id {kinds['route_id']}, ts {kinds['ts']}, off_m double, is_off boolean, along_m double, remaining_m double, fraction double"
    return stateful(flat, ["device", "route_id"], core, out, "off boolean")


#: Rows of a key that are folded in one go, about.
CHUNK_ROWS = 16_384


def _rates(progress: DataFrame, alpha: float, settle: int, min_s: float) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = progress.select("key", us.alias("us"), F.col("bytes").cast("bigint").alias("bytes"), F.col("total").cast("bigint").alias("total"), "ts")
    spans = rows.groupBy(F.col("key").alias("of")).agg(F.min("us").alias("lo"), (F.max("us") - F.min("us") + 1).alias("span"), F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).alias("parts"))
    chunk = F.floor((F.col("us") - F.col("lo")) / F.col("span") * F.col("parts")).cast("bigint")
    whole = rows.join(spans, F.col("key").eqNullSafe(F.col("of"))).select("key", chunk.alias("chunk"), F.struct("us", "bytes", "total", "ts").alias("r"))
    chunks = whole.groupBy("key", "chunk").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    before = F.lag(F.element_at("rows", -1)).over(Window.partitionBy("key").orderBy("chunk"))
    seconds = "(r.us - p.us) / 1e6"
    sample = f"CASE WHEN {seconds} >= {float(min_s)} AND r.bytes > p.bytes THEN (r.bytes - p.bytes) / ({seconds}) END"
    samples = f"transform(zip_with(rows, concat(array(before), slice(rows, 1, size(rows) - 1)), (r, p) -> struct(r, p)), x -> get(transform(array(x), x -> get(transform(array(x.r), r -> get(transform(array(x.p), p -> {sample}), 0)), 0)), 0))"
    chunks = stored(chunks.withColumn("before", before).withColumn("samples", F.expr(samples)).drop("before"), "chunks")
    step = lambda rate: f"CASE WHEN x IS NULL THEN {rate} WHEN {rate} IS NULL THEN x ELSE {alpha} * x + {1 - alpha} * {rate} END"
    # A chunk takes an unknown rate to ``fresh`` and a known one to a * rate + b.
    maps = chunks.select("key", "chunk", F.expr(f"""aggregate(samples, named_struct('n', 0L, 'fresh', CAST(NULL AS DOUBLE), 'a', 1D, 'b', 0D), (s, x) -> named_struct(
      'n', s.n + CASE WHEN x IS NULL THEN 0L ELSE 1L END, 'fresh', {step("s.fresh")},
      'a', CASE WHEN x IS NULL THEN s.a ELSE s.a * {1 - alpha} END, 'b', CASE WHEN x IS NULL THEN s.b ELSE {alpha} * x + {1 - alpha} * s.b END))""").alias("m"))
    scanned = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "m"))).alias("maps")).select("key", F.explode(F.expr("""aggregate(maps,
      named_struct('rate', CAST(NULL AS DOUBLE), 'n', 0L, 'out', CAST(array() AS ARRAY<STRUCT<chunk: BIGINT, rate: DOUBLE, n: BIGINT>>)),
      (s, x) -> named_struct('rate', CASE WHEN s.rate IS NULL THEN x.m.fresh ELSE x.m.a * s.rate + x.m.b END, 'n', s.n + x.m.n, 'out', array_append(s.out, named_struct('chunk', x.chunk, 'rate', s.rate, 'n', s.n)))).out""")).alias("c"))
    scanned = scanned.select(F.col("key").alias("of"), F.col("c.chunk").alias("at"), F.col("c.rate").alias("rate"), F.col("c.n").alias("n"))
    told = chunks.join(scanned, F.col("key").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")))
    values = f"""aggregate(samples, named_struct('rate', rate, 'n', n, 'out', CAST(array() AS ARRAY<DOUBLE>)), (s, x) -> named_struct(
      'rate', {step("s.rate")}, 'n', s.n + CASE WHEN x IS NULL THEN 0L ELSE 1L END,
      'out', array_append(s.out, CASE WHEN s.n + CASE WHEN x IS NULL THEN 0L ELSE 1L END >= {int(settle)} THEN {step("s.rate")} END))).out"""
    each = told.select("key", F.explode(F.arrays_zip("rows", F.expr(values).alias("rate"))).alias("v")).select("key", "v.rows.*", "v.rate")
    left = F.when((F.col("rate") > 0) & (F.col("total") > F.col("bytes")), (F.col("total") - F.col("bytes")) / F.col("rate"))
    return each.select("key", "ts", "rate", left.alias("eta"))


def transfer_rate(progress: DataFrame, alpha: float = 0.3, settle: int = 3, min_s: float = 0.1) -> DataFrame:
    """Smoothed bytes a second and seconds left for each row (key, ts, bytes, total).

    Samples under ``min_s`` apart or without gain move the baseline only; nothing is told before ``settle`` samples. On tables
    no Python runs, and a key's rows are dealt over tasks in chunks of about ``CHUNK_ROWS``, of equal times.
    """
    if not progress.isStreaming:
        return _rates(progress, alpha, settle, min_s)

    def core(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        at, had, rate, n = state or (None, 0, None, 0)
        rates, etas = [], []
        for ts, now, total in zip(rows["ts"].astype("int64") / 1e9 if rows["ts"].dtype.kind == "M" and str(rows["ts"].dtype).endswith("[ns]") else rows["ts"].map(pd.Timestamp.timestamp), rows["bytes"], rows["total"]):
            if at is not None:
                seconds, gain = ts - at, now - had
                if seconds >= min_s and gain > 0:
                    rate, n = (gain / seconds if rate is None else alpha * gain / seconds + (1 - alpha) * rate), n + 1
            at, had = ts, int(now)
            known = rate if n >= settle else None
            rates.append(known)
            etas.append((total - now) / known if known and total > now else None)
        return (at, had, rate, n), rows[["key", "ts"]].assign(rate=pd.Series(rates, index=rows.index, dtype="float64"), eta=pd.Series(etas, index=rows.index, dtype="float64"))

    kinds = dict(progress.dtypes)
    return stateful(progress, ["key"], core, f"key {kinds['key']}, ts {kinds['ts']}, rate double, eta double", "at double, had long, rate double, n int")


def heading_changes(readings: DataFrame) -> DataFrame:
    """Readings (device, ts, heading) whose whole degree differs from the last one told, or that appear or vanish."""
    if not readings.isStreaming:
        w = Window.partitionBy("device").orderBy("ts")
        now = F.when(~F.isnan(F.col("heading").cast("double")), F.floor(F.col("heading").cast("double") + 0.5))
        return readings.withColumn("__now", now).withColumn("__was", F.lag("__now").over(w)).where(~F.col("__now").eqNullSafe(F.col("__was"))).select("device", "ts", F.col("heading").cast("double").alias("heading"))

    def core(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        last, keep = state[0] if state else None, []
        for h in rows["heading"]:
            now = None if pd.isna(h) else int((h + 0.5) // 1)
            keep.append(now != last)
            last = now
        return (last,), rows.loc[keep, ["device", "ts", "heading"]]

    kinds = dict(readings.dtypes)
    return stateful(readings, ["device"], core, f"device {kinds['device']}, ts {kinds['ts']}, heading double", "last int")


def latest_fix(fixes: DataFrame) -> DataFrame:
    """The newest fix of each device (device, ts, lng, lat); on a stream use update mode."""
    return fixes.groupBy("device").agg(F.max_by(F.struct("ts", "lng", "lat"), F.struct("ts", "lng", "lat")).alias("r")).select("device", "r.*")


def fix_slope_alert(fixes: DataFrame, regions: DataFrame, cells: DataFrame, per_degree: float) -> DataFrame:
    """Region, slope and octant at each fix, null where there is none: region boxes and cells are joined by grid cell.

    ``cells`` has row and col on a grid of ``per_degree`` cells to a degree. Both sides of the joins may be a stream and a table.
    """
    step = 0.25
    boxes = regions.select("region_id", "w", "s", "e", "n", "region_ord").withColumn("cx", F.explode(F.sequence(F.floor(F.col("w") / step), F.floor(F.col("e") / step))))
    boxes = boxes.withColumn("cy", F.explode(F.sequence(F.floor(F.col("s") / step), F.floor(F.col("n") / step))))
    pools = boxes.groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.struct("region_ord", "region_id", "w", "s", "e", "n"))).alias("pool"))
    at = fixes.withColumn("cx", F.floor(F.col("lng") / step)).withColumn("cy", F.floor(F.col("lat") / step)).join(pools, ["cx", "cy"], "left")
    holds = F.filter("pool", lambda b: F.col("lng").between(b["w"], b["e"]) & F.col("lat").between(b["s"], b["n"]))
    at = at.withColumn("region_id", F.get(holds, F.lit(0))["region_id"]).withColumn("row", F.floor(F.col("lat") * per_degree)).withColumn("col", F.floor(F.col("lng") * per_degree))
    slopes = cells.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "slope", "octant")
    return at.join(slopes, ["row", "col"], "left").select("device", "ts", "region_id", "slope", "octant")
