"""The road network: build, snap, positions, augmentation.

vertices: vid, x, y, component. arcs: arc_id, u, v, length, with u < v. Segments are straight."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import materialize, numbered, require


def significant(value: Column, digits: int) -> Column:
    """Rounded, half to even, to so many significant digits."""
    factor = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.rint(value * factor) / factor)


def rounded(value: Column, digits: int | None, decimal: bool) -> Column:
    if digits is None:
        return value
    return F.bround(value, digits) if decimal else significant(value, digits)


def build_network(lines: DataFrame, digits: int | None = 11, decimal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices and arcs of lines (line_id, part, coords: array of x, y).

    Consecutive coordinates of a part are joined; segments without length are left out, and of equal ones, in either
    direction, one is kept. Vertices are numbered by x, y, arcs by u, v. Crossings without a common vertex don't connect.
    digits: significant ones, or decimal ones as the restart counts them."""
    points = lines.select("line_id", "part", F.posexplode("coords").alias("pos", "c")).select(
        "line_id", "part", "pos", rounded(F.col("c.x"), digits, decimal).alias("x"), rounded(F.col("c.y"), digits, decimal).alias("y")
    )
    require(points.where("x is null or y is null or isnan(x) or isnan(y) or abs(x) = double('Infinity') or abs(y) = double('Infinity')").select("line_id"), "lines with coordinates that aren't finite")
    w = Window.partitionBy("line_id", "part").orderBy("pos")
    here = F.struct("x", "y")
    segments = points.withColumn("a", here).withColumn("b", F.lead(here).over(w)).where("b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    segments = materialize(segments, "segments")
    if segments.isEmpty():
        raise ValueError("no road has a length")
    ends = segments.select(F.col("a").alias("p")).union(segments.select("b")).distinct().select("p.x", "p.y")
    vertices = materialize(numbered(ends, [F.col("x"), F.col("y")], "vid"), "vertices")
    at = lambda side: vertices.select(F.struct("x", "y").alias(side), F.col("vid").alias("u" if side == "a" else "v"))
    arcs = segments.join(at("a"), "a").join(at("b"), "b").select("u", "v", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("length"))
    arcs = materialize(numbered(arcs, [F.col("u"), F.col("v")], "arc_id").select("arc_id", "u", "v", "length"), "arcs")
    return with_components(vertices, arcs), arcs


def with_components(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """vertices with component, the smallest vertex that roads lead to."""
    found = components(arcs.select("u", "v")).select(F.col("node").alias("vid"), F.col("label").alias("component"))
    return materialize(vertices.drop("component").join(found, "vid", "left").withColumn("component", F.coalesce("component", "vid")), "vertices")


def _segment_distance(out: DataFrame) -> DataFrame:
    """Distance of px, py from the segment ax, ay - bx, by, and the place on it; the ends exactly."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = ((F.col("px") - F.col("ax")) * dx + (F.col("py") - F.col("ay")) * dy) / (dx * dx + dy * dy)
    out = out.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    place = lambda a, b: F.when(F.col("t") <= 0, F.col(a)).when(F.col("t") >= 1, F.col(b)).otherwise(F.col(a) + F.col("t") * (F.col(b) - F.col(a)))
    out = out.withColumn("sx", place("ax", "bx")).withColumn("sy", place("ay", "by"))
    return out.withColumn("d", F.hypot(F.col("px") - F.col("sx"), F.col("py") - F.col("sy")))


def arc_ends(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """arcs with ax, ay, bx, by."""
    a = vertices.select(F.col("vid").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = vertices.select(F.col("vid").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return arcs.join(a, "u").join(b, "v")


def near_arcs(points: DataFrame, ends: DataFrame, cell: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Every arc at the smallest distance from each point (id, px, py): id, arc columns, t, sx, sy, d. by: columns of both sides that
    must be equal; ids differ between their values.

    Points meet arcs in grid cells of several sizes, each a power of two. With a reach, an arc is on the level of its own extent, or of the reach if that
    is larger, and in the few cells there that its box, widened by the reach, touches; a point looks at the one cell of each level that it is in. So a pair
    meets once, and a long arc is in few cells. A distance up to the reach is proven; the points beyond are tried again with twice the reach, until none is left."""
    reach = cell
    if reach is None:
        reach = ends.agg(F.percentile_approx("length", 0.5)).first()[0]
    reach = 2.0 ** math.ceil(math.log2(reach or 1.0))
    proven, todo = None, points
    own = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    sized = ends.withColumn("own_level", F.when(own > 0, F.ceil(F.log2(own))).otherwise(-1074).cast("int"))
    box = ends.agg(F.min(F.least("ax", "bx")), F.min(F.least("ay", "by")), F.max(F.greatest("ax", "bx")), F.max(F.greatest("ay", "by"))).first()
    span = max(box[2] - box[0], box[3] - box[1])
    present = sorted(r[0] for r in sized.select("own_level").distinct().collect())  # one for each doubling of an arc's extent
    side = F.pow(F.lit(2.0), F.col("level"))
    while True:
        least_level = round(math.log2(reach))
        levels = sorted({max(least_level, k) for k in present})
        number = lambda c: F.floor(c / side).cast("long")
        touched = lambda a, b, r=reach, n=number: F.explode(F.sequence(n(F.least(a, b) - r), n(F.greatest(a, b) + r)))
        arcs = sized.withColumn("level", F.greatest(F.lit(least_level), "own_level")).drop("own_level").withColumn("cx", touched("ax", "bx")).withColumn("cy", touched("ay", "by"))
        looking = todo.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("cx", number(F.col("px"))).withColumn("cy", number(F.col("py")))
        pairs = _segment_distance(looking.join(arcs, ["level", "cx", "cy", *by]).drop("level", "cx", "cy"))
        least = pairs.groupBy("id").agg(F.min("d").alias("least"))
        final = reach > 2 * span  # then all arcs are in the cells looked at, for points near the network's box
        found = materialize(pairs.join(least, "id").where(F.col("d") == F.col("least")).where((F.col("d") <= reach) if not final else F.lit(True)).drop("least"), "near-arcs")
        proven = found if proven is None else proven.unionByName(found)
        todo = materialize(todo.join(found.select("id").distinct(), "id", "left_anti"), "far-points")
        if todo.isEmpty():
            return proven
        reach *= 2
        if not math.isfinite(reach):
            raise ValueError("points without a nearest road")


#: Places whose nearest arcs are broadcast to the points (about 120 bytes each).
SNAPPED_PLACES = 200_000


def _sent(places: DataFrame) -> DataFrame:
    """A written table of places, broadcast to the points that it is joined with unless it has too many."""
    return F.broadcast(places) if places.count() <= SNAPPED_PLACES else places


def snap(points: DataFrame, vertices: DataFrame, arcs: DataFrame, tolerance: bool = False) -> DataFrame:
    """points (point_id, x, y, ...) with arc_id, u, v, arc_length, snap_offset, snap_distance, snapped_x, snapped_y, component.

    The nearest arc, of equally near ones that with the smallest number; the offset is measured from u. With tolerance,
    offsets within max(1e-10, length * 1e-12) of an end are that end. Points with the same coordinates are looked up as one."""
    looking = materialize(points.select(F.struct("x", "y").alias("id"), F.col("x").alias("px"), F.col("y").alias("py")).dropDuplicates(["id"]), "snap-places")
    near = near_arcs(looking, arc_ends(vertices, arcs))
    best = near.groupBy("id").agg(F.min_by(F.struct("arc_id", "u", "v", "length", "t", "d", "sx", "sy"), "arc_id").alias("s"))
    offset = F.col("s.t") * F.col("s.length")
    if tolerance:
        slack = F.greatest(F.lit(1e-10), F.col("s.length") * 1e-12)
        offset = F.when(offset <= slack, F.lit(0.0)).when(F.col("s.length") - offset <= slack, F.col("s.length")).otherwise(offset)
    found = best.select(
        F.col("id.x").alias("px"), F.col("id.y").alias("py"), "s.arc_id", "s.u", "s.v", F.col("s.length").alias("arc_length"), offset.alias("snap_offset"), F.col("s.d").alias("snap_distance"), F.col("s.sx").alias("snapped_x"), F.col("s.sy").alias("snapped_y")
    )
    found = materialize(found.join(vertices.select(F.col("vid").alias("u"), "component"), "u"), "snapped-places")
    out = points.join(_sent(found), (F.col("x") == F.col("px")) & (F.col("y") == F.col("py"))).drop("px", "py")
    return out.select("point_id", *[c for c in out.columns if c != "point_id"])


def place_key(snapped: DataFrame) -> DataFrame:
    """Adds kind, a, b, off: a vertex by its number, or a place inside an arc by its ends and offset. Places of different arcs never are one."""
    at_u, at_v = F.col("snap_offset") <= 0, F.col("snap_offset") >= F.col("arc_length")
    vertex = F.when(at_u, F.col("u")).when(at_v, F.col("v"))
    return snapped.withColumn("kind", F.when(at_u | at_v, 0).otherwise(1)).withColumn("a", F.coalesce(vertex, F.col("u"))).withColumn("b", F.when(at_u | at_v, F.lit(-1).cast("long")).otherwise(F.col("v"))).withColumn(
        "off", F.when(at_u | at_v, F.lit(0.0)).otherwise(F.col("snap_offset"))
    )


#: What makes a place of a type.
PLACE = ["type", "kind", "a", "b", "off"]


def positions(snapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct places of each type, numbered by place: (type, position, kind, a, b, off, u, v, arc_length, component, weight), and
    (point_id, type, position). weight is the number of points there; u, v and offset are of one of them, chosen by place alone."""
    facts = ["arc_id", "u", "v", "arc_length", "snap_offset", "snap_distance", "snapped_x", "snapped_y", "component"]
    counted = snapped.groupBy("type", *facts).agg(F.count("*").alias("n"))  # only counts change, so each task adds its points up without sorting them
    keyed = place_key(counted).withColumn("own_offset", F.col("snap_offset"))
    keys = PLACE
    rep = F.min_by(F.struct("u", "v", "arc_length", "own_offset", "component"), F.struct("u", "v", "snap_distance", "snapped_x", "snapped_y")).alias("r")
    places = keyed.groupBy(*keys).agg(F.sum("n").alias("weight"), rep)
    w = Window.partitionBy("type").orderBy("kind", "a", "b", "off")
    places = materialize(places.withColumn("position", (F.row_number().over(w) - 1).cast("long")).select("type", "position", "kind", "a", "b", "off", "r.u", "r.v", "r.arc_length", F.col("r.own_offset").alias("offset"), "r.component", "weight"), "positions")
    return places, positioned(snapped, places).select("point_id", "type", "position")


def positioned(snapped: DataFrame, places: DataFrame) -> DataFrame:
    """snapped with the position of each point among places (see positions)."""
    return place_key(snapped).join(_sent(places.select(*PLACE, "position")), PLACE).select(*snapped.columns, "position")


def augment(vertices: DataFrame, arcs: DataFrame, snapped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of inserted(), and (point_id, node)."""
    nodes, edges, points = inserted(vertices, arcs, snapped)
    return nodes, edges, materialize(points.select("point_id", "node"), "point-nodes")


def inserted(vertices: DataFrame, arcs: DataFrame, snapped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The network with every snapped place as a vertex: nodes (node, x, y, component), edges (aug_edge_id, u, v, length,
    parent_edge_id, from_offset, to_offset), and snapped with the node of each point.

    Offsets within max(1e-10, length * 1e-12) of an end are that end; equal places share a node. New nodes follow the old
    ones, by arc and offset. The lengths of an arc's pieces add up to its own, which is checked."""
    slack = F.greatest(F.lit(1e-10), F.col("arc_length") * 1e-12)
    inside = (F.col("snap_offset") > slack) & (F.col("arc_length") - F.col("snap_offset") > slack)
    s = snapped.withColumn("inside", inside)
    cuts = s.where("inside").groupBy("arc_id", F.col("snap_offset").alias("off")).agg(F.first("component").alias("component"))
    cuts = materialize(cuts, "cuts")
    base = vertices.agg(F.max("vid")).first()[0] + 1
    named = materialize(numbered(cuts, [F.col("arc_id"), F.col("off")], "node", base), "cut-nodes") if not cuts.isEmpty() else cuts.withColumn("node", F.lit(0).cast("long"))
    ends = arc_ends(vertices, arcs)
    t = F.col("off") / F.col("length")
    new = named.join(ends, "arc_id").select("node", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"), "component")
    nodes = materialize(vertices.select(F.col("vid").alias("node"), "x", "y", "component").unionByName(new), "aug-nodes")
    touched = arcs.join(named.select("arc_id").distinct(), "arc_id", "left_semi")
    stops = named.select("arc_id", "off", "node").unionByName(touched.select("arc_id", F.lit(0.0).alias("off"), F.col("u").alias("node"))).unionByName(touched.select("arc_id", F.col("length").alias("off"), F.col("v").alias("node")))
    w = Window.partitionBy("arc_id").orderBy("off")
    pieces = stops.withColumn("next", F.lead("node").over(w)).withColumn("to", F.lead("off").over(w)).where("next is not null")
    pieces = pieces.select(F.least("node", "next").alias("u"), F.greatest("node", "next").alias("v"), (F.col("to") - F.col("off")).alias("length"), F.col("arc_id").alias("parent_edge_id"), F.col("off").alias("from_offset"), F.col("to").alias("to_offset"))
    whole = arcs.join(named.select("arc_id").distinct(), "arc_id", "left_anti").select("u", "v", "length", F.col("arc_id").alias("parent_edge_id"), F.lit(0.0).alias("from_offset"), F.col("length").alias("to_offset"))
    edges = materialize(numbered(whole.unionByName(pieces), [F.col("parent_edge_id"), F.col("from_offset")], "aug_edge_id"), "aug-edges")
    sums = edges.groupBy(F.col("parent_edge_id").alias("arc_id")).agg(F.sum("length").alias("sum")).join(arcs, "arc_id")
    require(sums.where(F.abs(F.col("sum") - F.col("length")) > F.greatest(F.lit(1e-9), F.col("length") * 1e-9)).select("arc_id", "length", "sum"), "arcs whose pieces have another length")
    end = F.when(F.col("snap_offset") * 2 < F.col("arc_length"), F.col("u")).otherwise(F.col("v"))
    cut = _sent(named.select("arc_id", F.col("off").alias("off_"), F.col("node").alias("cut_")))
    placed = s.withColumn("off_", F.when(F.col("inside"), F.col("snap_offset"))).join(cut, ["arc_id", "off_"], "left")
    return nodes, edges, placed.select(*snapped.columns, F.when(F.col("inside"), F.col("cut_")).otherwise(end).alias("node"))


def check_augmented(nodes: DataFrame, edges: DataFrame) -> None:
    """A restored network: consecutive node numbers, edges between nodes, of positive length, none twice."""
    n, low, high, different = nodes.agg(F.count("*"), F.min("node"), F.max("node"), F.count_distinct("node")).first()
    if n and (low != 0 or high != n - 1 or different != n):
        raise ValueError("node numbers must be 0 to n - 1, each once")
    require(edges.where(~(F.col("length") > 0)).select("aug_edge_id"), "edges without a length")
    require(edges.where(f"u < 0 or v < 0 or u >= {n} or v >= {n}").select("aug_edge_id"), "edges to nodes that don't exist")
    require(edges.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).count().where("count > 1"), "repeated edges")
