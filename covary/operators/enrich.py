"""Joins that attach indicator values, code ranges and nearest areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.functions.stats import let
from covary.operators._util import Cols, as_list, null_safe_join
from covary.operators.sized import guarded_join
from covary.session import materialize

# Mean Earth radius in km and the degree -> radian factor.
EARTH_RADIUS_KM = 6371.0
DEG2RAD = 0.017453292519943295


def with_indicator(df: DataFrame, indicator: DataFrame, on: Cols,
                   fill: float | None = None, how: str = "left",
                   broadcast: bool = False) -> DataFrame:
    """Attach indicator columns by key; missing values become ``fill``.

    ``broadcast=True`` is for indicators that are expected to be small (one
    row per calendar month, a lookup list); the size is measured
    (:func:`covary.operators.sized.guarded_join`) and a large one is joined by
    a salted shuffle. Without it Spark decides, and AQE turns the join into a
    broadcast at run time when the indicator turns out small.
    """
    keys = as_list(on)
    out = guarded_join(df, indicator, keys, how) if broadcast else null_safe_join(df, indicator, keys, how)
    if fill is not None:
        value_cols = [c for c in indicator.columns if c not in keys]
        names = {c.lower() for c in value_cols}
        out = out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(fill).cast(t)).alias(c)
                           if c.lower() in names and t not in ("string", "boolean", "date", "timestamp") else F.col(f"`{c}`")
                           for c, t in out.dtypes])
    return out


def code_ranges(df: DataFrame, code: str | Column, ranges: Sequence[tuple],
                closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Rows whose code lies in any of the given ranges, one row per match.

    ``ranges`` is a list of ``(lo, hi)`` or ``(lo, hi, label)``; each match
    adds ``range_lo, range_hi, range_label``. The ranges are literals of the
    plan: every row is tested against them in generated code and the matches
    are exploded, so there is neither a join nor a shuffle of the facts.
    Overlapping ranges give one row per matching range.
    """
    # bounds as given: one type for all, fractions kept
    kind = int if all(float(b).is_integer() for r in ranges for b in r[:2]) else float
    rows = [(kind(r[0]), kind(r[1]), str(r[2]) if len(r) > 2 else f"{r[0]}-{r[1]}") for r in ranges]
    c = F.col(code) if isinstance(code, str) else code
    hits = []
    for lo, hi, label in rows:
        lo_ok = c >= F.lit(lo) if closed[0] else c > F.lit(lo)
        hi_ok = c <= F.lit(hi) if closed[1] else c < F.lit(hi)
        hits.append(F.when(lo_ok & hi_ok, F.struct(F.lit(lo).alias("range_lo"), F.lit(hi).alias("range_hi"),
                                                   F.lit(label).alias("range_label"))))
    cols = [F.col(f"`{n}`") for n in df.columns]
    # ranges that do not fit are dropped before the rows are copied
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    out = df.select(*cols, F.explode(found).alias("__rng"))
    return out.select(*cols, "__rng.range_lo", "__rng.range_hi", "__rng.range_label")


def range_join(df: DataFrame, ranges: DataFrame, code: str, lo: str = "lo", hi: str = "hi",
               closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Rows of ``df`` with every row of a range *table* whose ``lo .. hi``
    holds their ``code``, as an equi-join on bins.

    A range is put into the bins of its own width class, 2 ** k >= hi - lo, of
    which it meets two at most, whatever its width; a row looks once into
    each width class that occurs (one row per class is read on the driver, at
    most 86). Matches of a bin are tested exactly after the join.
    Ranges may overlap, repeat and be of any number; those with a NULL or NaN
    bound, or lo above hi, hold nothing. Ranges without an end, and those
    wider than 2 ** 64, share one class of one bin; those below 2 ** -20 share
    one class, too. Columns of the ranges
    follow those of ``df`` and must be called differently.
    """
    x, a, b = (F.col(f"`{c}`").cast("double") for c in (code, lo, hi))
    widest, finest = 64, -20
    width = F.when((a == float("-inf")) | (b == float("inf")) | (b - a > float(2 ** widest)), F.lit(widest + 1)).otherwise(
        F.greatest(F.lit(finest), F.ceil(F.log2(F.greatest(b - a, F.lit(2.0 ** finest)))).cast("int")))
    asked = (ranges.filter(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (a <= b))
                   .select("*", width.alias("__k")))
    classes = sorted(r[0] for r in asked.select("__k").distinct().collect())

    def bin_of(value: Column, k: Column) -> Column:
        # beyond the range of a long the floor stays at its end: still in order
        return F.when(k > widest, F.lit(0).cast("long")).otherwise(F.floor(value / F.pow(F.lit(2.0), k)))

    first, last = bin_of(a, F.col("__k")), bin_of(b, F.col("__k"))
    keyed = asked.withColumn("__bin", F.explode(F.array_distinct(F.array(first, last))))
    cols = [F.col(f"`{c}`") for c in df.columns]
    looks = F.explode(F.array(*[F.lit(k) for k in classes])) if classes else F.explode(F.array().cast("array<int>"))
    rows = df.filter(x.isNotNull() & ~F.isnan(x)).select(*cols, looks.alias("__k"))
    rows = rows.withColumn("__bin", bin_of(x, F.col("__k")))
    left = x >= a if closed[0] else x > a
    right = x <= b if closed[1] else x < b
    return rows.join(keyed, ["__k", "__bin"]).filter(left & right).select(
        *cols, *[F.col(f"`{c}`") for c in ranges.columns])


def in_open_range(code: str | Column, lo: float, hi: float,
                  closed: tuple[bool, bool] = (False, False)) -> Column:
    """Predicate ``lo < code < hi`` (bounds inclusive per ``closed``)."""
    c = F.col(code) if isinstance(code, str) else code
    a = c >= lo if closed[0] else c > lo
    b = c <= hi if closed[1] else c < hi
    return a & b


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km between two (lat, lon) degree pairs."""
    def _c(x):
        return F.col(x) if isinstance(x, str) else x
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dphi = (lat2 - lat1) * F.lit(DEG2RAD)
    dlmb = (lon2 - lon1) * F.lit(DEG2RAD)
    s1 = F.sin(dphi / 2)
    s2 = F.sin(dlmb / 2)
    a = s1 * s1 + F.cos(lat1 * F.lit(DEG2RAD)) * F.cos(lat2 * F.lit(DEG2RAD)) * s2 * s2
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


#: Each level of the pyramid cuts a cell into FAN parts along every axis.
FAN = 4
#: Levels at most: the finest cells are about 12 metres wide.
DEEPEST = 10
#: Centroids that a cell of the last level holds, unless it is the finest.
CELL = 8
#: Bounds are compared with this much room for rounding (squared chords).
_SLACK, _ROOM = 1.0 + 1e-9, 1e-15


def _on_sphere(lat: str, lon: str) -> list[Column]:
    """A point of the unit sphere: no seam at the date line, no poles."""
    la, lo = F.col(lat) * F.lit(DEG2RAD), F.col(lon) * F.lit(DEG2RAD)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _cell(level: Column, axes: Sequence[Column]) -> Column:
    """Number of the cell of a point on a level."""
    n = F.pow(F.lit(float(FAN)), level)
    out = F.lit(0).cast("long")
    for c in axes:
        at = F.least(F.floor((c + 1) / 2 * n), n.cast("long") - 1)
        out = out * F.lit(FAN ** DEEPEST) + F.greatest(F.lit(0).cast("long"), at)
    return out


def _pyramid(cen: DataFrame) -> tuple[DataFrame, int]:
    """Every non-empty cell of every level with its box and its parent cell,
    and the level on which cells are small (the finest if none is)."""
    axes = ["__x", "__y", "__z"]
    at = cen.select(*axes, F.explode(F.sequence(F.lit(1), F.lit(DEEPEST))).alias("level"))
    cells = at.groupBy("level", _cell(F.col("level"), [F.col(a) for a in axes]).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{b}{a}") for a in axes for f, b in ((F.min, "lo"), (F.max, "hi"))],
        # the parent's number follows from any point in the cell
        F.first(_cell(F.col("level") - 1, [F.col(a) for a in axes])).alias("parent"))
    cells = materialize(cells)
    fullest = {r["level"]: r["n"] for r in cells.groupBy("level").agg(F.max("n").alias("n")).collect()}
    small = [k for k, n in sorted(fullest.items()) if n <= CELL]
    return cells, small[0] if small else DEEPEST


def nearest_candidates(points: DataFrame, cells: DataFrame, depth: int, here: Sequence[str]) -> DataFrame:
    """``here`` and ``cells``: per point the cells of level ``depth`` that may
    hold its nearest centroid (branch and bound down the pyramid).

    A point keeps the children of its cells whose smallest possible distance
    is not above the smallest of their largest possible ones. The first level
    has 64 cells at most and comes as one array; the others are joined by
    their parent, and Spark broadcasts a level that is small. The points stay
    partitioned by their coordinates all the way down.
    """
    p = {a: F.col(f"__p{a}") for a in ("x", "y", "z")}

    def bounds(lo, hi):
        near = far = F.lit(0.0)
        for a in ("x", "y", "z"):
            outside = F.greatest(lo(a) - p[a], p[a] - hi(a), F.lit(0.0))
            reach = F.greatest(F.abs(p[a] - lo(a)), F.abs(p[a] - hi(a)))
            near, far = near + outside * outside, far + reach * reach
        return near, far

    def kept(found: Column) -> Column:
        return let(found, lambda c: let(F.array_min(F.transform(c, lambda s: s["far"])), lambda best: F.transform(
            F.filter(c, lambda s: s["near"] <= best * F.lit(_SLACK) + F.lit(_ROOM)), lambda s: s["cell"])))

    box = [f"{b}__{a}" for a in ("x", "y", "z") for b in ("lo", "hi")]
    first = cells.filter("level = 1").agg(F.collect_list(F.struct("cell", *box)).alias("c")).select("c").scalar()

    def opened(s):
        near, far = bounds(lambda a: s[f"lo__{a}"], lambda a: s[f"hi__{a}"])
        return F.struct(s["cell"].alias("cell"), near.alias("near"), far.alias("far"))

    carried = [*here, "__px", "__py", "__pz"]
    frontier = (points.withColumn("__first", first)
                      .withColumn("cells", kept(F.transform("__first", opened))).drop("__first"))
    for level in range(2, depth + 1):
        child = cells.filter(F.col("level") == level).select("parent", F.col("cell").alias("child"), *box)
        pairs = (frontier.withColumn("__cell", F.explode("cells")).drop("cells")
                         .join(child, F.col("__cell") == F.col("parent")))
        near, far = bounds(lambda a: F.col(f"lo__{a}"), lambda a: F.col(f"hi__{a}"))
        frontier = (pairs.select(*carried, F.struct(F.col("child").alias("cell"), near.alias("near"), far.alias("far")).alias("s"))
                         .groupBy(*carried).agg(F.collect_list("s").alias("s"))
                         .select(*carried, kept(F.col("s")).alias("cells")))
    return frontier


def nearest_area(points: DataFrame, centroids: DataFrame, point_key: str,
                 area_key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Exact nearest centroid (haversine) for every point, by branch and bound.

    The centroids lie in a pyramid of cells on the unit sphere; each cell has
    the box of its centroids, so a point knows a smallest and a largest
    distance to each. It goes down only into cells that can hold its nearest
    centroid (:func:`nearest_candidates`): far away it compares with a few
    cells, not with their centroids, and in a dense city it meets the few
    cells around it. The levels end where cells hold at most ``CELL``
    centroids. The plan is one chain of joins, without a loop over results.

    Rows with a NULL or NaN coordinate are dropped. The search runs over the
    distinct coordinates of both sides, so keys may repeat or be NULL, and a
    coordinate that very many points share is one point; its result is joined
    back to the rows. Nothing is capped: points at the same distance from
    very many cells (a circle of centroids around them) meet all of these.

    Ties at equal distance go to the smallest ``area_key``. Returns
    ``point_key, area_key, dist_km``.
    """
    def placed(df, key, y, x):
        a, b = F.col(lat).cast("double") + F.lit(0.0), F.col(lon).cast("double") + F.lit(0.0)
        return (df.select(F.col(key), a.alias(y), b.alias(x))
                  .filter(F.col(y).isNotNull() & F.col(x).isNotNull() & ~F.isnan(y) & ~F.isnan(x)))

    rows = placed(points, point_key, "__plat", "__plon")
    here = ["__plat", "__plon"]
    cen = (placed(centroids, area_key, "__clat", "__clon").groupBy("__clat", "__clon")
           .agg(F.min(F.struct(area_key)).alias("__a")).select("__clat", "__clon", f"__a.{area_key}"))
    cen = cen.withColumns(dict(zip(("__x", "__y", "__z"), _on_sphere("__clat", "__clon"))))
    cells, depth = _pyramid(cen)
    pts = rows.select(*here).distinct()
    pts = pts.withColumns(dict(zip(("__px", "__py", "__pz"), _on_sphere(*here))))
    found = nearest_candidates(pts, cells, depth, here)
    # an empty table of centroids leaves the array NULL, and no row
    pairs = found.select(*here, F.explode("cells").alias("__cell")).join(
        cen.withColumn("__cell", _cell(F.lit(depth), [F.col(a) for a in ("__x", "__y", "__z")])), "__cell")
    dist = haversine_km("__plat", "__plon", "__clat", "__clon")
    best = pairs.groupBy(*here).agg(F.min(F.struct(dist.alias("dist_km"), F.col(area_key).alias("__area"))).alias("__best"))
    out = best.select(*here, F.col("__best.__area").alias(area_key), F.col("__best.dist_km").alias("dist_km"))
    return rows.join(out, here, "inner").select(point_key, area_key, "dist_km")
