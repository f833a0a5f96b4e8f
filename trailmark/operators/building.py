"""Building a map: networks from lines, places snapped onto them, straight joints spliced out, rings from ways, and plans placed by fits.

Networks are nodes(id, x, y) and edges(a, b), undirected, ids as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways, nearest_on_edges, written

# Metres of detour that a removed joint may hide, square metres of a joint's triangle that is still straight, and metres from an end that count as at it.
DETOUR, STRAIGHT_AREA, AT_END = 0.3, 0.01, 1.0


def _joints(nodes: DataFrame, edges: DataFrame, keep: Column) -> DataFrame:
    """id, a, b and the doubled triangle area and detour of every place of degree two that keep doesn't hold."""
    own = both_ways(edges.select("a", "b").where("a <> b").distinct()).distinct().groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("_n")).where(F.size("_n") == 2)
    at = lambda c: nodes.select(F.col("id").alias(c), F.col("x").alias(f"_{c}x"), F.col("y").alias(f"_{c}y"))
    free = nodes.where(~keep).select("id")
    three = own.select(F.col("a").alias("id"), F.get("_n", F.lit(0)).alias("a"), F.get("_n", F.lit(1)).alias("b")).join(free, "id").join(at("id"), "id").join(at("a"), "a").join(at("b"), "b")
    dist = lambda p, q: F.hypot(F.col(f"_{p}x") - F.col(f"_{q}x"), F.col(f"_{p}y") - F.col(f"_{q}y"))
    area = F.abs((F.col("_idx") - F.col("_ax")) * (F.col("_by") - F.col("_ay")) - (F.col("_idy") - F.col("_ay")) * (F.col("_bx") - F.col("_ax")))
    return three.select("id", "a", "b", area.alias("area"), (dist("a", "id") + dist("id", "b") - dist("a", "b")).alias("detour"))


def _spliced(nodes: DataFrame, edges: DataFrame, keep: Column, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Takes out joints that gone accepts, round by round until none is left; in a round no two neighbours go, and of neighbours the one of lesser hash does, so
    that a chain of any length takes few rounds.

    A joint whose neighbours are linked already stays: its ways are a triangle.
    """
    nodes, edges = written(nodes, "map-nodes"), written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "map-edges")
    while True:
        j = _joints(nodes, edges, keep).where(gone)
        linked = edges.select(F.col("a").alias("_l"), F.col("b").alias("_h"))
        j = written(j.join(linked, (F.least("a", "b") == F.col("_l")) & (F.greatest("a", "b") == F.col("_h")), "left_anti"), "map-joints")
        if j.isEmpty():
            return nodes, edges
        near = j.select("id", F.explode(F.array("a", "b")).alias("_by")).join(j.select(F.col("id").alias("_by")), "_by", "left_semi")
        beaten = near.where(F.struct(F.xxhash64("_by"), "_by") < F.struct(F.xxhash64("id"), "id")).select("id").distinct()
        # two joints with the same neighbours would give the same edge: the lesser goes first
        first = j.join(beaten, "id", "left_anti").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("id").alias("id"))
        first = written(first, "map-gone")
        off = lambda c: first.select(F.col("id").alias(c))
        edges = written(edges.join(off("a"), "a", "left_anti").join(off("b"), "b", "left_anti").select("a", "b").unionByName(first.select("a", "b")), "map-edges")
        nodes = written(nodes.join(off("id"), "id", "left_anti"), "map-nodes")


def simplified(nodes: DataFrame, edges: DataFrame, keep: Column, detour: float = DETOUR) -> tuple[DataFrame, DataFrame]:
    """The network without places of degree two whose removal shortens the way by less than detour metres. keep: places that stay."""
    return _spliced(nodes, edges, keep, F.col("detour") < detour)


def locating_network(nodes: DataFrame, edges: DataFrame, keep: Column, area: float = STRAIGHT_AREA) -> tuple[DataFrame, DataFrame]:
    """The network to locate on: without edges marked route_only, and without straight joints."""
    return _spliced(nodes, edges.where("not route_only"), keep, F.col("area") <= area)


def snapped(points: DataFrame, nodes: DataFrame, edges: DataFrame, cell: float = 20.0, at_end: float = AT_END) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places put onto the network: (point, node) pairs, nodes and edges.

    A point of points(point, x, y) goes to the nearest place on an edge: to an end, a before b, that is less than at_end metres from it along the edge, to a nanometre, else to a
    new node "snap-" and its name, which splits the edge. All points of an edge split it together.
    """
    at = lambda c: nodes.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    seg = written(edges.select("a", "b").distinct().join(at("a"), "a").join(at("b"), "b").withColumn("edge", F.concat_ws("|", "a", "b")), "map-segments")
    near = nearest_on_edges(points, seg, [], cell).where("edge is not null").join(seg.select("edge", "a", "b", "ax", "ay", "bx", "by"), "edge")
    size = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    from_a, from_b = F.round(F.col("share") * size, 9), F.round((1 - F.col("share")) * size, 9)
    end = F.when(from_a < at_end, F.col("a")).when(from_b < at_end, F.col("b"))
    near = near.withColumn("node", F.coalesce(end, F.concat(F.lit("snap-"), F.col("point").cast("string")))).withColumn("_new", end.isNull())
    near = written(near.select("point", "node", "_new", "edge", "share", (F.col("ax") + F.col("share") * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + F.col("share") * (F.col("by") - F.col("ay"))).alias("y")), "map-snapped")
    new = near.where("_new")
    stops = seg.select("edge", F.lit(0.0).alias("share"), F.col("a").alias("node")).unionByName(seg.select("edge", F.lit(1.0).alias("share"), F.col("b").alias("node"))).unionByName(new.select("edge", "share", "node"))
    w = Window.partitionBy("edge").orderBy("share", "node")
    parts = stops.select(F.lag("node").over(w).alias("a"), F.col("node").alias("b")).where("a is not null and a <> b")
    return near.select("point", "node"), nodes.select("id", "x", "y").unionByName(new.select(F.col("node").alias("id"), "x", "y")), parts


def corridors(lines: DataFrame, doors: DataFrame, places: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a floor from corridor lines(line, points: array of [x, y]) and doors(point, x, y).

    Points that agree to so many decimal places are one node. Doors hang on the nearest corridor by an edge of their own.
    """
    p = lines.select("line", F.posexplode("points").alias("pos", "p")).select("line", "pos", F.round(F.get("p", F.lit(0)), places).alias("x"), F.round(F.get("p", F.lit(1)), places).alias("y"))
    p = p.withColumn("id", F.concat_ws("_", F.lit("c"), F.col("x").cast("string"), F.col("y").cast("string")))
    w = Window.partitionBy("line").orderBy("pos")
    edges = p.select(F.lag("id").over(w).alias("a"), F.col("id").alias("b")).where("a is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    at, nodes, edges = snapped(doors.select("point", "x", "y"), p.select("id", "x", "y").distinct(), edges)
    own = doors.select(F.concat(F.lit("door-"), F.col("point").cast("string")).alias("id"), "x", "y")
    return nodes.unionByName(own), edges.unionByName(at.select(F.concat(F.lit("door-"), F.col("point").cast("string")).alias("a"), F.col("node").alias("b")))


def rings(ways: DataFrame, keys: list[str]) -> DataFrame:
    """Closed rings of ways(keys, way, nodes) whose ends meet: keys, ring (from 0) and nodes, the first again at the end.

    A key's ways (one outline of a building) are put together in one task; they are few by nature. A ring begins with the least way left, along its
    own direction, and takes at each end the least way that goes on there; chains that don't close are left out.
    """
    kinds = dict(ways.dtypes)
    of = F.array_sort(F.collect_list(F.struct("way", "nodes")))

    def closed(left: list[list]) -> list[list]:
        left, out = [n for n in left if n is not None and len(n) > 1], []
        while left:
            ring = left.pop(0)
            while ring[0] != ring[-1]:
                i = next((i for i, n in enumerate(left) if ring[-1] in (n[0], n[-1])), None)
                if i is None:
                    break
                nxt = left.pop(i)
                ring = ring + (nxt if nxt[0] == ring[-1] else nxt[::-1])[1:]
            if ring[0] == ring[-1] and len(ring) > 3:
                out.append(ring)
        return out

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(row, i, ring) for row, left in enumerate(b.column("_ways").to_pylist()) for i, ring in enumerate(closed(left))]
            whose = b.select(keys).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*whose.columns, pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], b.schema.field("_ways").type.value_type)], [*keys, "ring", "nodes"])

    whole = ways.groupBy(*keys).agg(of.alias("_w")).select(*keys, F.transform("_w", lambda w: w["nodes"]).alias("_ways"))
    return whole.mapInArrow(join, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["ring int", f"nodes {kinds['nodes']}"]))


def placed(points: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """points(keys, x, y) moved by graph.similarity()'s fits: px, py. This lays a plan onto the map by pairs of places known in both."""
    on = points.join(fits.select(*keys, "scale", "rotation", "dx", "dy"), keys)
    c, s = F.cos(F.radians("rotation")), F.sin(F.radians("rotation"))
    px, py = F.col("scale") * (c * F.col("x") - s * F.col("y")) + F.col("dx"), F.col("scale") * (s * F.col("x") + c * F.col("y")) + F.col("dy")
    return on.select(*points.columns, px.alias("px"), py.alias("py"))


def homographies(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """h, eight numbers, of the projective map from (x, y) to (u, v) per key, least squares over four pairs or more; no row where pairs don't fix it."""
    kinds = dict(pairs.dtypes)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        x, y, u, v = (g[c].to_numpy(float) for c in ("x", "y", "u", "v"))
        one, zero = np.ones(len(g)), np.zeros(len(g))
        m = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], 1)])
        h, _, rank, _ = np.linalg.lstsq(m, np.concatenate([u, v]), rcond=None)
        return pd.DataFrame([(*(g[k].iloc[0] for k in keys), h.tolist())] if rank == 8 else [], columns=[*keys, "h"])

    return pairs.groupBy(*keys).applyInPandas(solve, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["h array<double>"]))


def projected(x: Column, y: Column, h: Column) -> tuple[Column, Column]:
    """Where a homography takes a point."""
    at = lambda i: F.get(h, F.lit(i))
    below = at(6) * x + at(7) * y + 1
    return (at(0) * x + at(1) * y + at(2)) / below, (at(3) * x + at(4) * y + at(5)) / below
