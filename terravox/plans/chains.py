"""Operation chains: command-line style lists of steps that become one lazy plan.

A step is a name and its arguments, in the order in which they are to run. Nothing runs until the result is used, so
Catalyst sees the whole chain.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, grid, predicates, props

Args = list[str]


class Chain:
    """Named steps with a number of arguments each."""

    def __init__(self, steps: dict[str, tuple[int, Callable]]) -> None:
        self.steps = steps

    def parse(self, words: Sequence[str]) -> list[tuple[str, Args]]:
        out, left = [], list(words)
        while left:
            name = left.pop(0).lstrip("-")
            if name not in self.steps:
                raise ValueError(f"no step {name}; there are {', '.join(sorted(self.steps))}")
            n = self.steps[name][0]
            if len(left) < n:
                raise ValueError(f"{name} takes {n} arguments")
            out.append((name, left[:n]))
            del left[:n]
        return out

    def run(self, df: DataFrame, words: Sequence[str], **context) -> DataFrame:
        for name, args in self.parse(words):
            df = self.steps[name][1](df, args, context)
        return df


def _number(text: str) -> float | None:
    """A number, or keep/unknown."""
    return None if text in ("keep", "unknown") else float(text)


_BOTH: dict[str, tuple[int, Callable]] = {
    **{n: (0, lambda c, a, x, n=n: grid.unary(c, n)) for n in grid.UNARY},
    "normalize": (0, lambda c, a, x: grid.normalize(c)),
    "clear": (1, lambda c, a, x: grid.apply(c, F.lit(float(a[0])))),
    "add": (1, lambda c, a, x: grid.apply(c, grid.V + float(a[0]))),
    "subtract": (1, lambda c, a, x: grid.apply(c, grid.V - float(a[0]))),
    "multiply": (1, lambda c, a, x: grid.apply(c, grid.V * float(a[0]))),
    "divide": (1, lambda c, a, x: grid.divide_by(c, float(a[0]))),
    "pow": (1, lambda c, a, x: grid.power(c, float(a[0]))),
    "blur": (1, lambda c, a, x: grid.blur(c, float(a[0]))),
    "threshold": (3, lambda c, a, x: grid.threshold(c, float(a[0]), _number(a[1]), _number(a[2]))),
    "substitute": (2, lambda c, a, x: grid.substitute(c, _number(a[0]), _number(a[1]))),
    "transpose": (0, lambda c, a, x: grid.reflect(c, x["resolution"])),
    "gradient_magnitude": (0, lambda c, a, x: grid.gradient_magnitude(c, x["resolution"])),
    "signed_distance": (0, lambda c, a, x: graph.signed_distance(c, x["resolution"])),
    "squared_distance": (0, lambda c, a, x: graph.squared_distance(c, x["resolution"]).drop("nearest").withColumnRenamed("d2", "value")),
    "voronoi": (0, lambda c, a, x: graph.voronoi(c, x["resolution"]).drop("d2")),
    "dilate": (1, lambda c, a, x: graph.dilate(c, float(a[0]), x["resolution"])),
    "erode": (1, lambda c, a, x: graph.erode(c, float(a[0]), x["resolution"])),
    **{f"{n}_grid": (1, lambda c, a, x, n=n: grid.combine(c, x["grids"][a[0]], n)) for n in ("add", "subtract", "multiply", "divide", "mask", "min", "max", "overlay")},
    "median_filter": (1, lambda c, a, x: grid.percentile_filter(c, int(a[0]), 0.5)),
    "min_filter": (1, lambda c, a, x: grid.percentile_filter(c, int(a[0]), 0.0)),
    "max_filter": (1, lambda c, a, x: grid.percentile_filter(c, int(a[0]), 1.0)),
    "percentile_filter": (2, lambda c, a, x: grid.percentile_filter(c, int(a[0]), float(a[1]))),
    "bilateral_filter": (2, lambda c, a, x: grid.bilateral(c, float(a[0]), float(a[1]))),
    "mask_non_minima": (1, lambda c, a, x: grid.mask_non_extrema(c, int(a[0]), False)),
    "mask_non_maxima": (1, lambda c, a, x: grid.mask_non_extrema(c, int(a[0]), True)),
}

GRID3 = Chain(_BOTH | {
    "laplacian": (0, lambda c, a, x: grid.convolve(c, grid.LAPLACE3, x["resolution"])),
    **{f"gradient_{n}": (0, lambda c, a, x, n=n: grid.gradient(c, f"i{n}", x["resolution"])) for n in "xyz"},
    "slice": (2, lambda c, a, x: c.where(F.col(f"i{a[0]}") == int(a[1])).drop(f"i{a[0]}")),
})

GRID2 = Chain(_BOTH | {
    "laplacian": (0, lambda c, a, x: grid.convolve(c, grid.LAPLACE2, x["resolution"])),
    "dx": (0, lambda c, a, x: grid.gradient(c, "ix", x["resolution"])),
    "dy": (0, lambda c, a, x: grid.gradient(c, "iy", x["resolution"])),
    "gradient_x": (0, lambda c, a, x: grid.gradient(c, "ix", x["resolution"])),
    "gradient_y": (0, lambda c, a, x: grid.gradient(c, "iy", x["resolution"])),
    "edges": (0, lambda c, a, x: grid.gradient_magnitude(c, x["resolution"])),
    "sobel": (0, lambda c, a, x: grid.gradient_magnitude(c, x["resolution"])),
    "gradient_angle": (0, lambda c, a, x: grid.gradient_angle(c, x["resolution"])),
    **{f"hessian_{p}{q}": (0, lambda c, a, x, p=p, q=q: grid.hessian(c, f"i{p}", f"i{q}", x["resolution"])) for p in "xy" for q in "xy"},
    "harris_corner_filter": (2, lambda c, a, x: grid.harris(c, int(a[0]), float(a[1]), x["resolution"])),
    "corners": (0, lambda c, a, x: grid.harris(c, 3, 0.05, x["resolution"])),
    "fill_gaps": (1, lambda c, a, x: grid.fill_gaps(grid.fill_gaps(c, "ix", int(a[0])), "iy", int(a[0]))),
    "du": (0, lambda c, a, x: grid.forward_difference(c, "ix")),
    "dv": (0, lambda c, a, x: grid.forward_difference(c, "iy")),
    "hash": (1, lambda c, a, x: grid.quantise(c, int(a[0]))),
    "connected_component_filter": (4, lambda c, a, x: graph.component_filter(c, graph.grid_components(c, float(a[0]), x["resolution"]), float(a[0]), int(a[1]), float(a[2]), float(a[3]))),
})

#: Operations on one property column.
PROPERTY: dict[str, tuple[int, Callable[[DataFrame, str, Args, dict], DataFrame]]] = {
    **{n.capitalize(): (0, lambda p, c, a, x, n=n: props.unary(p, c, n)) for n in props.UNARY},
    "Clear": (1, lambda p, c, a, x: p.withColumn(c, F.lit(float(a[0])))),
    "Normalize": (0, lambda p, c, a, x: props.normalize(p, c)),
    "Percentile": (0, lambda p, c, a, x: props.percentilize(p, c)),
    "Substitute": (2, lambda p, c, a, x: props.substitute(p, c, _number(a[0]), _number(a[1]))),
    **{n.capitalize(): (1, lambda p, c, a, x, n=n: props.arithmetic(p, c, n, a[0] if a[0] in p.columns else float(a[0]))) for n in ("add", "subtract", "multiply", "divide", "pow")},
    "Mask": (1, lambda p, c, a, x: props.mask(p, c, a[0])),
    "Threshold": (3, lambda p, c, a, x: props.threshold(p, c, float(a[0]), _number(a[1]), _number(a[2]))),
    "Blur": (1, lambda p, c, a, x: p.drop(c).join(props.blur(p, c, x["distances"], float(a[0])), props.KEY)),
    "Laplace": (0, lambda p, c, a, x: p.drop(c).join(props.laplacian(p, c, x["edges"]), props.KEY)),
    "DoG": (1, lambda p, c, a, x: p.join(props.blur(p, c, x["distances"], float(a[0])).withColumnRenamed(c, "_b"), props.KEY).withColumn(c, F.col(c) - F.col("_b")).drop("_b")),
}


def _replace(p: DataFrame, a: Args, x: dict) -> DataFrame:
    n, f = PROPERTY[a[1]]
    return f(p, a[0], a[2].split(",") if n else [], x)


def _insert(p: DataFrame, a: Args, x: dict) -> DataFrame:
    """name operation arguments new-name"""
    return _replace(props.insert(p, a[3], F.col(a[0])), [a[3], a[1], a[2]], x)


PROPERTIES = Chain({
    "select": (1, lambda p, a, x: props.select(p, *a[0].split(","))),
    "remove": (1, lambda p, a, x: p.drop(*a[0].split(","))),
    "rename": (2, lambda p, a, x: props.rename(p, a[0], a[1])),
    "sort": (0, lambda p, a, x: p.select(props.KEY, *sorted(c for c in p.columns if c != props.KEY))),
    "merge": (1, lambda p, a, x: props.merge(p, x["others"][a[0]])),
    "replace": (3, _replace),
    "insert": (4, _insert),
})


def constraint(words: Sequence[str]) -> predicates.Constraint:
    """A constraint from words such as: BoundingBox -1 -1 0 1 1 2 Object 7 Timestamp 0 10 Mark marked."""
    left, out = list(words), []
    take = lambda n: [float(left.pop(0)) for _ in range(n)]
    while left:
        kind = left.pop(0)
        if kind == "BoundingBox":
            v = take(6)
            out.append(predicates.box(v[:3], v[3:]))
        elif kind == "OrientedBoundingBox":
            v = take(15)
            out.append(predicates.oriented_box(v[:3], (v[3:6], v[6:9], v[9:12]), v[12:]))
        elif kind == "Sphere":
            v = take(4)
            out.append(predicates.sphere(v[:3], v[3]))
        elif kind == "Cylinder":
            v = take(6)
            out.append(predicates.cylinder(v[:3], *v[3:]))
        elif kind == "Timestamp":
            out.append(predicates.timestamp(*take(2)))
        elif kind == "Elevation":
            out.append(predicates.elevation(*take(2)))
        elif kind in ("X", "Y", "Z"):
            out.append(predicates.coordinate(kind.lower(), *take(2)))
        elif kind == "Object":
            out.append(predicates.of_object(int(left.pop(0))))
        elif kind == "Label":
            out.append(predicates.of_label(left.pop(0)))
        elif kind == "Mark":
            which = left.pop(0)
            out.append(predicates.mark(which == "marked", which == "unmarked"))
        elif kind == "Source":
            which = left.pop(0)
            out.append(predicates.source(which == "aerial", which == "terrestrial"))
        else:
            raise ValueError(f"no constraint {kind}")
    return predicates.all_of(out)
