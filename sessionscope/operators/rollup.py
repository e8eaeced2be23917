"""Totals and per-dimension totals from one pass over the sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.functions.rates import ratio


def _label(dimension: str, key: Column) -> Column:
    return F.struct(F.lit(dimension).alias("dimension"), key.cast("string").alias("key"))


def dimension_rollup(
    sessions: DataFrame,
    together: tuple[str, ...],
    alone: tuple[str, ...] = (),
    total: bool = True,
    moments: tuple[str, str] | None = None,
    **sums: Column,
) -> DataFrame:
    """``(dimension, key, *sums)``: one row per value of each dimension.

    ``dimension = 'all'`` is the grand total.  ``sums`` must be sums or counts.

    Sessions first collapse to one cell per combination of the dimensions
    ``together`` (meant for small domains), and the cells then roll up to the
    single dimensions: the fact rows are hashed once instead of once per
    dimension.  Dimensions that would multiply the cells, such as days or
    places, go into ``alone`` and get a grouping set of their own.  Either way
    map-side aggregation leaves a few rows per task to shuffle, whatever the skew.

    ``moments`` names two numeric columns x and y and adds ``n_xy, xx, xy, yy``: how many rows have both, and the
    sums of squares and products of deviations from the means of the whole table.  Cells carry their own
    means and deviations; the means of the table come from the cells, so deviations stay exact and add up.
    """
    totals = [column.alias(name) for name, column in sums.items()]
    if moments:
        totals += _cell_moments(*moments)
    labels = F.array(
        *[_label(d, F.col(d)) for d in together], *([_label("all", F.lit(None))] if total else [])
    )
    if alone:
        sets = [[F.col(d)] for d in alone] + [[F.col(d) for d in together]]
        cells = sessions.groupingSets(sets, *[F.col(d) for d in (*alone, *together)]).agg(
            *totals, *[F.grouping(d).alias(f"_no_{d}") for d in alone]
        )
        choice = F
        for d in alone:
            choice = choice.when(F.col(f"_no_{d}") == 0, F.array(_label(d, F.col(d))))
        labels = choice.otherwise(labels)
        whole = reduce(lambda a, b: a & b, [F.col(f"_no_{d}") == 1 for d in alone])
    else:
        cells = sessions.groupBy(*together).agg(*totals)
        whole = F.lit(True)
    names = list(sums)
    if moments:
        cells, names = _about_the_mean(cells, whole), [*names, "n_xy", "xx", "xy", "yy"]
    return (
        cells.select(F.inline(labels), *names)
        .groupBy("dimension", "key")
        .agg(*[F.sum(name).alias(name) for name in names])
    )


def _cell_moments(x: str, y: str) -> list[Column]:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = (F.when(both, F.col(name).cast("double")) for name in (x, y))
    return [
        F.count(u).alias("n_xy"),
        F.avg(u).alias("_mean_x"),
        F.avg(v).alias("_mean_y"),
        F.var_pop(u).alias("_var_x"),
        F.var_pop(v).alias("_var_y"),
        F.covar_pop(u, v).alias("_covar"),
    ]


def _about_the_mean(cells: DataFrame, whole: Column) -> DataFrame:
    """Cell moments moved to the means of the table; the window is over cells, ``whole`` marks one full set of them."""
    everything = Window.partitionBy()
    weight = F.when(whole, F.col("n_xy"))
    n = F.col("n_xy")

    def off(axis: str) -> Column:
        mean = F.sum(weight * F.col(f"_mean_{axis}")).over(everything) / F.nullif(F.sum(weight).over(everything), F.lit(0))
        return F.col(f"_mean_{axis}") - mean

    moved = cells.withColumns({"_off_x": off("x"), "_off_y": off("y")})
    x, y = F.col("_off_x"), F.col("_off_y")
    return moved.withColumns(
        {"xx": n * (F.col("_var_x") + x * x), "xy": n * (F.col("_covar") + x * y), "yy": n * (F.col("_var_y") + y * y)}
    )


def moment_rollup(
    sessions: DataFrame, together: tuple[str, ...], values: dict[str, Column], **sums: Column
) -> DataFrame:
    """``dimension_rollup`` that also gives ``<value>_n``, ``<value>_mean`` and ``<value>_var`` (sample variance).

    Sessions collapse once, to cells with counts, means and population variances; cells roll up to
    each label by moving their deviations to the label's mean.  No row is copied per dimension.
    """
    cells = sessions.groupBy(*together).agg(
        *[column.alias(name) for name, column in sums.items()],
        *[F.count(v).alias(f"{name}_n") for name, v in values.items()],
        *[F.avg(v).alias(f"{name}_mean") for name, v in values.items()],
        *[F.var_pop(v).alias(f"{name}_var") for name, v in values.items()],
    )
    labels = F.array(*[_label(d, F.col(d)) for d in together], _label("all", F.lit(None)))
    labelled = cells.select(F.inline(labels), *[c for c in cells.columns if c not in together])
    # Windows over cells: a few rows per label.
    label = Window.partitionBy("dimension", "key")

    def n(name: str) -> Column:
        return F.col(f"{name}_n")

    whole = {
        f"{name}_whole": ratio(F.sum(n(name) * F.col(f"{name}_mean")).over(label), F.sum(n(name)).over(label)) for name in values
    }
    off = {name: F.col(f"{name}_mean") - F.col(f"{name}_whole") for name in values}
    spread = {name: F.sum(n(name) * (F.col(f"{name}_var") + off[name] * off[name])) for name in values}
    return (
        labelled.withColumns(whole)
        .groupBy("dimension", "key")
        .agg(
            *[F.sum(name).alias(name) for name in sums],
            *[F.sum(n(name)).alias(f"{name}_n") for name in values],
            *[F.max(f"{name}_whole").alias(f"{name}_mean") for name in values],
            *[F.when(F.sum(n(name)) > 1, ratio(spread[name], F.sum(n(name)) - 1)).alias(f"{name}_var") for name in values],
        )
    )
