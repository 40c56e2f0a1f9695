"""Places of nodes: bounds, rescaling, force-directed layouts.

Graphs of MOST_NODES nodes at most are laid out on the driver, with every pair repelling. Larger ones are laid out on executors by the same forces, but nodes repel
through the cells of a grid, as Fruchterman and Reingold propose for large graphs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

#: Larger graphs are laid out on executors, on a grid of GRID x GRID cells, in LARGE_STEPS steps at most.
MOST_NODES = 1000
GRID, LARGE_STEPS = 32, 50


def bounds(nodes: DataFrame) -> DataFrame:
    """One row: min_x, max_x, min_y, max_y."""
    return nodes.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def rescaled(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """nodes with x and y moved and scaled by one factor so that they fill a width and a height around their middle."""
    box = bounds(nodes).first()  # one row
    if box.min_x is None or box.min_y is None:
        return nodes
    by = min(width / max(box.max_x - box.min_x, 1e-12), height / max(box.max_y - box.min_y, 1e-12))
    middle = (box.max_x + box.min_x) / 2, (box.max_y + box.min_y) / 2
    return nodes.withColumns({"x": (F.col("x") - middle[0]) * by, "y": (F.col("y") - middle[1]) * by})


def _is_small(nodes: DataFrame) -> bool:
    return nodes.select("id").limit(MOST_NODES + 1).count() <= MOST_NODES


def _small(nodes: DataFrame, edges: DataFrame) -> tuple[dict, list[tuple[int, int]]]:
    """Numbers of the nodes, and of the ends of edges between them; MOST_NODES nodes at most, so their square bounds the edges."""
    names = nodes.select("id")
    at = {name: k for k, name in enumerate(sorted(r.id for r in names.collect()))}
    one, two = (F.broadcast(names.withColumnRenamed("id", c)) for c in ("source", "target"))
    between = edges.select("source", "target").filter("source <> target").join(one, "source", "left_semi").join(two, "target", "left_semi").distinct()
    return at, [(at[r.source], at[r.target]) for r in between.collect()]


def _large(nodes: DataFrame, edges: DataFrame, iterations: int, seed: int, side: float, forces: Callable) -> DataFrame:
    """nodes with x and y after some steps. forces(step, steps, mass_a, mass_b, distance) gives columns: repulsion between two masses, pull of an edge, pull to
    the middle, and how far a node with a force may move. Each step is a table of its own, so a lost executor costs one step."""
    random = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40) * side
    links = edges.select("source", "target").filter("source <> target").distinct()
    names = nodes.select("id").distinct()
    links = links.join(names.withColumnRenamed("id", "source"), "source", "left_semi").join(names.withColumnRenamed("id", "target"), "target", "left_semi")
    links = stored(links.select(F.inline(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"))))).distinct(), "links")
    degrees = links.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    now = stored(names.join(degrees, "id", "left").select("id", (F.coalesce("degree", F.lit(0)) + 1.0).alias("mass"), random(0).alias("x"), random(1).alias("y")), "places")
    steps = min(iterations, LARGE_STEPS)
    for step in range(steps):
        box = bounds(now).first()
        wide, high = max(box.max_x - box.min_x, 1e-9), max(box.max_y - box.min_y, 1e-9)
        cell = lambda c, low, size: F.least(F.lit(GRID - 1), F.floor((F.col(c) - low) / size * GRID)).cast("int")
        placed = now.withColumn("cell", cell("x", box.min_x, wide) * GRID + cell("y", box.min_y, high))  # noqa: B023
        # GRID * GRID rows at most, which go to all tasks as literals.
        cells = placed.groupBy("cell").agg(F.sum("mass").alias("mass"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
        table = F.array(*(F.struct(F.lit(c.cell).alias("cell"), F.lit(float(c.mass)).alias("mass"), F.lit(c.x).alias("x"), F.lit(c.y).alias("y"), F.lit(c.n).alias("n")) for c in cells))

        def push(axis: str, table: Column = table, step: int = step) -> Column:
            def one(total, c):
                dx, dy = F.col("x") - c["x"], F.col("y") - c["y"]
                distance = F.sqrt(F.greatest(dx * dx + dy * dy, F.lit((wide / GRID) ** 2 / 16)))  # noqa: B023
                mass = F.when(c["cell"] == F.col("cell"), F.greatest(c["mass"] - F.col("mass"), F.lit(0.0))).otherwise(c["mass"])
                others = F.when(c["cell"] == F.col("cell"), c["n"] - 1).otherwise(c["n"])
                return total + (dx if axis == "x" else dy) / distance * forces(step, steps, F.col("mass"), mass, others, distance)[0]

            return F.aggregate(table, F.lit(0.0), one)

        here = placed.select("id", "mass", "x", "y", push("x").alias("px"), push("y").alias("py"))
        ends = links.join(now.select("id", "x", "y"), "id").join(now.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")), "other")
        dx, dy = F.col("ox") - F.col("x"), F.col("oy") - F.col("y")
        distance = F.sqrt(F.greatest(dx * dx + dy * dy, F.lit(1e-18)))
        pull = forces(step, steps, None, None, None, distance)[1]
        pulls = ends.groupBy("id").agg(F.sum(dx / distance * pull).alias("qx"), F.sum(dy / distance * pull).alias("qy"))
        moved = here.join(pulls, "id", "left")
        away = F.sqrt(F.greatest(F.col("x") ** 2 + F.col("y") ** 2, F.lit(1e-12)))
        inwards = forces(step, steps, F.col("mass"), None, None, away)[2]
        fx = F.col("px") + F.coalesce("qx", F.lit(0.0)) - inwards * F.col("x") / away
        fy = F.col("py") + F.coalesce("qy", F.lit(0.0)) - inwards * F.col("y") / away
        moved = moved.select("id", "mass", "x", "y", fx.alias("fx"), fy.alias("fy")).withColumn("f", F.greatest(F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2), F.lit(1e-12)))
        go = F.least(F.col("f"), F.lit(side * 0.1 * (1 - step / steps))) / F.col("f")
        now = stored(moved.select("id", "mass", (F.col("x") + F.col("fx") * go).alias("x"), (F.col("y") + F.col("fy") * go).alias("y")), "places")
    return nodes.drop("x", "y").join(now.select("id", "x", "y"), "id")


def _with_places(nodes: DataFrame, at: dict, place: np.ndarray) -> DataFrame:
    where = nodes.sparkSession.createDataFrame([(k, float(place[v, 0]), float(place[v, 1])) for k, v in at.items()], "id string, x double, y double")
    return nodes.drop("x", "y").join(F.broadcast(where), "id")


def force_layout(nodes: DataFrame, edges: DataFrame, iterations: int = 500, seed: int = 0) -> DataFrame:
    """nodes with x and y by Fruchterman and Reingold's method (1991): all nodes repel, ends of edges attract, moves shrink. Over MOST_NODES: by grid cells, in LARGE_STEPS
    steps at most."""
    if not _is_small(nodes):
        ideal2 = 1 / nodes.count()

        def forces(step, steps, mass_a, mass_b, others, distance):
            return (None if others is None else others * ideal2 / distance), distance * distance / ideal2**0.5, F.lit(0.0)

        return _large(nodes, edges, iterations, seed, 1.0, forces)
    at, pairs = _small(nodes, edges)
    n = len(at)
    rng = np.random.default_rng(seed)
    place = rng.random((n, 2))
    ideal = (1 / max(n, 1)) ** 0.5
    a, b = (np.array([p[k] for p in pairs], int) for k in (0, 1))
    for step in range(iterations if n > 1 else 0):
        apart = place[:, None] - place[None]
        distance = np.maximum(np.linalg.norm(apart, axis=2), 1e-9)
        move = (apart * (ideal**2 / distance**2)[:, :, None]).sum(1)
        along = place[a] - place[b]
        pull = along * (np.linalg.norm(along, axis=1) / ideal)[:, None]
        np.add.at(move, a, -pull)
        np.add.at(move, b, pull)
        length = np.maximum(np.linalg.norm(move, axis=1), 1e-9)
        place += move / length[:, None] * np.minimum(length, 0.1 * (1 - step / iterations))[:, None]
    return _with_places(nodes, at, place)


def gravity_layout(nodes: DataFrame, edges: DataFrame, iterations: int = 200, gravity: float = 1.0, scaling: float = 10.0, seed: int = 0) -> DataFrame:
    """nodes with x and y by ForceAtlas2's forces (Jacomy and others 2014): repulsion by degrees, linear attraction along edges,
    gravity towards the middle, and a speed that falls where nodes swing. Over MOST_NODES: by grid cells, in LARGE_STEPS steps at most, with moves that shrink."""
    if not _is_small(nodes):

        def forces(step, steps, mass_a, mass_b, others, distance):
            return (None if mass_b is None else scaling * mass_a * mass_b / distance), distance, (F.lit(0.0) if mass_a is None else gravity * mass_a)

        return _large(nodes, edges, iterations, seed, 100.0, forces)
    at, pairs = _small(nodes, edges)
    n = len(at)
    place = np.random.default_rng(seed).random((n, 2)) * 100
    a, b = (np.array([p[k] for p in pairs], int) for k in (0, 1))
    mass = np.ones(n)
    np.add.at(mass, np.r_[a, b], 1)
    before = np.zeros((n, 2))
    for _ in range(iterations if n > 1 else 0):
        apart = place[:, None] - place[None]
        distance = np.maximum((apart**2).sum(2), 1e-6)
        move = (apart * (scaling * mass[:, None] * mass[None] / distance)[:, :, None]).sum(1)
        along = place[a] - place[b]
        np.add.at(move, a, -along)
        np.add.at(move, b, along)
        move -= gravity * mass[:, None] * place / np.maximum(np.linalg.norm(place, axis=1), 1e-6)[:, None]
        swing = np.linalg.norm(move - before, axis=1)
        place += move * (0.1 / (1 + np.sqrt(swing)))[:, None]
        before = move
    return _with_places(nodes, at, place)
