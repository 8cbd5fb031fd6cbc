"""Exact order statistics and running totals that never need one big task.

Three building blocks serve every ordered operator of the library:

``running_totals``  cumulative sums over pre-aggregated rows. A table whose row
    count is known to be small uses one window; a larger one is range
    partitioned, summed per partition, and offset by the totals before it.
``exact_quantiles`` quantiles of many columns of one table. A mergeable sketch
    brackets each wanted rank, then only the values inside the brackets move.
``group_quantiles`` quantiles per group: large groups are bracketed by a sketch
    each, so a hot group moves only the values around its ranks.
``cut_at``          the predicate of the first so many rows. Exact counts below
    sampled values narrow the cut's bracket scan by scan, for any ordered type.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, materialize_counted

# Narrow rows one task may order, or hold as value -> count maps: some 200 MB.
TASK_ROWS = 4_000_000
# Rank error of the bracketing sketch is n / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000
# The same for the sketches of groups, of which a task may hold many.
GROUP_ACCURACY = 1_000
# Groups of more than TASK_ROWS rows whose brackets may be broadcast (some 100 bytes each).
BROADCAST_GROUPS = 100_000
# Values that cut a bracket in one scan of ``cut_at``.
SPLITTERS = 64
_PART = "_range_part"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which NULL keys are equal; the keys appear once."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"_r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = False,
    task_rows: int = TASK_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Add ``cum_<s>``, the running sum of each ``s`` in ``order`` within ``keys``.

    ``df`` must hold one row per (keys, order): aggregate first, which also
    collapses ties and hot values. Give ``rows`` when ``df`` is already
    materialized and counted.
    """
    keys = list(keys)
    saved = df
    if rows is None:
        saved, rows = materialize_counted(df)
    direction = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_last()
    if rows <= task_rows:
        window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(direction)
        window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return saved.select("*", *[F.sum(s).over(window).alias(f"cum_{s}") for s in sums])

    parts = [-(-rows // task_rows)] if task_rows else []  # 0 leaves the number to Spark
    ranged = materialize(
        saved.repartitionByRange(*parts, *[F.col(k) for k in keys], direction).withColumn(_PART, F.spark_partition_id())
    )
    # A key spans neighbouring partitions only, so this holds at most
    # (partitions + keys) rows.
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_PART)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, _PART).agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    offsets = totals.select(
        *keys, _PART, *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums]
    )
    within = Window.partitionBy(_PART, *keys).orderBy(direction)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return join_null_safe(ranged, offsets, [_PART, *keys]).select(
        *saved.columns, *[(F.col(f"_off_{s}") + F.sum(s).over(within)).alias(f"cum_{s}") for s in sums]
    )


def _interpolated(cum: str, value: str, position: Column) -> Column:
    """Linear interpolation between the two ranks around ``position`` (aggregate)."""
    low = F.min(F.when(F.col(cum) > F.floor(position), F.col(value)))
    high = F.min(F.when(F.col(cum) > F.ceil(position), F.col(value)))
    share = F.max(position - F.floor(position))
    return low + F.when(share > 0, (high - low) * share).otherwise(F.lit(0.0))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    task_rows: int = TASK_ROWS,
    accuracy: int = GROUP_ACCURACY,
) -> DataFrame:
    """Exact quantiles per group: ``keys..., n, quantiles array<double>``; NULLs ignored.

    Groups of at most ``task_rows`` rows are one aggregation. Of the larger ones a mergeable sketch per group
    brackets each wanted rank, a second scan counts what lies below the brackets, and only values inside them move. Nothing is
    written but the sizes of the groups, the brackets, and the counted values inside them.
    """
    keys = list(keys)
    data = df.where(F.col(value).isNotNull()).select(*keys, value)
    sizes, _ = materialize_counted(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    large, many = materialize_counted(sizes.where((F.col("n") > task_rows) & (F.col("n") > 0)))
    if not many:
        return _small_groups(data, keys, value, probabilities)
    found = _large_groups(data, large, many, keys, value, probabilities, task_rows, accuracy)
    if large.count() == sizes.count():
        return found
    bounded = F.broadcast(large.select(*keys)) if many <= BROADCAST_GROUPS else large.select(*keys)
    return _small_groups(_null_safe(data, bounded, keys, "left_anti"), keys, value, probabilities).unionByName(found)


def _small_groups(data: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    found = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col(value).cast("double"), wanted).alias("quantiles"))
    return found if keys else found.where("n > 0")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join in which NULL keys are equal; ``right`` keeps its keys under other names."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    joined = left.join(other, same, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_r_{k}" for k in keys])


def _large_groups(
    data: DataFrame, large: DataFrame, many: int, keys: Sequence[str], value: str, probabilities: Sequence[float], task_rows: int, accuracy: int
) -> DataFrame:
    small = many <= BROADCAST_GROUPS
    rows = _null_safe(data.withColumn("_v", F.col(value).cast("double")), F.broadcast(large) if small else large, keys, "inner")
    guard = 4.0 / accuracy
    points = sorted({min(1.0, max(0.0, float(p) + d)) for p in probabilities for d in (-guard, guard)})
    at = {x: i for i, x in enumerate(points)}
    sketch = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.percentile_approx("_v", points, accuracy).alias("_s"))
    low = F.array(*[F.col("_s")[at[max(0.0, float(p) - guard)]] for p in probabilities])
    high = F.array(*[F.col("_s")[at[min(1.0, float(p) + guard)]] for p in probabilities])
    marks = materialize(sketch.select(*keys, low.alias("_low"), high.alias("_high")))
    marked = _null_safe(rows, F.broadcast(marks) if small else marks, keys, "inner")
    count = len(probabilities)
    counted = marked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.first("_low").alias("_low"), F.first("_high").alias("_high"),
        F.array(*[F.count_if(F.col("_v") < F.col("_low")[j]) for j in range(count)]).alias("_below"),
        F.array(*[F.count_if(F.col("_v") <= F.col("_high")[j]) for j in range(count)]).alias("_upto"),
    )
    position = [(F.col("n") - 1) * F.lit(float(p)) for p in probabilities]
    # A bracket that misses its rank, which the sketch's error does not allow for, is opened on both sides.
    hit = [(F.col("_below")[j] <= F.floor(position[j])) & (F.col("_upto")[j] > F.ceil(position[j])) for j in range(count)]
    edges = materialize(counted.select(
        *keys, "n",
        F.array(*[F.when(hit[j], F.col("_low")[j]).otherwise(F.lit(float("-inf"))) for j in range(count)]).alias("_low"),
        F.array(*[F.when(hit[j], F.col("_high")[j]).otherwise(F.lit(float("nan"))) for j in range(count)]).alias("_high"),
        F.array(*[F.when(hit[j], F.col("_below")[j]).otherwise(F.lit(0)) for j in range(count)]).alias("_below"),
    ))
    near = _null_safe(rows.drop("n"), F.broadcast(edges) if small else edges, keys, "inner")
    inside = F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: (F.col("_v") >= F.col("_low")[j]) & (F.col("_v") <= F.col("_high")[j]))
    inner = near.select(*keys, "_v", inside.alias("_js")).where(F.size("_js") > 0).select(*keys, "_v", F.explode("_js").alias("_j"))
    ranked = running_totals(inner.groupBy(*keys, "_j", "_v").agg(F.count(F.lit(1)).alias("_c")), [*keys, "_j"], "_v", ["_c"], task_rows=task_rows)
    placed = _null_safe(ranked, F.broadcast(edges) if small else edges, keys, "inner") if keys else ranked.crossJoin(F.broadcast(edges))
    target = F.element_at(F.array(*position), F.col("_j") + 1) - F.col("_below")[F.col("_j")]
    picks = placed.withColumn("_at", target).groupBy(*keys, "_j").agg(F.max("n").alias("n"), _interpolated("cum__c", "_v", F.col("_at")).alias("_q"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_j", "_q"))), lambda x: x["_q"])
    return picks.groupBy(*keys).agg(F.max("n").alias("n"), ordered.alias("quantiles"))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    task_rows: int = TASK_ROWS,
    accuracy: int = SKETCH_ACCURACY,
    sizes: Mapping[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns; the result is columns x probabilities numbers.

    NULLs are ignored and the columns must be numeric. ``sizes`` holds the known
    counts of values, which saves a scan. Two scans and no shuffle
    of raw rows: the first bounds each wanted rank with a sketch, the second
    counts what lies below the bound and gathers only values inside it.
    """
    columns = list(columns)
    if not columns:
        return {}
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    guard = 4.0 / accuracy
    points = sorted({min(1.0, max(0.0, p + d)) for p in probabilities for d in (-guard, guard)} | {0.0, 1.0})
    if sizes is None:
        found = data.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        sizes = {c: found[f"n{i}"] for i, c in enumerate(columns)}
    counts = [sizes[c] for c in columns]
    if sum(counts) <= task_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        row = data.agg(*[F.percentile(c, wanted).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        return {c: row[f"q{i}"] or [None] * len(probabilities) for i, c in enumerate(columns)}

    sketch = data.agg(
        *[F.percentile_approx(c, [float(p) for p in points], accuracy).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    spans = {}
    for i in range(len(columns)):
        if counts[i]:
            at = {x: sketch[f"s{i}"][j] for j, x in enumerate(points)}
            spans[i] = _spans([(at[max(0.0, p - guard)], at[min(1.0, p + guard)]) for p in probabilities])
    if not spans:
        return out
    # One narrow row a value: a condition on many columns at once makes the optimizer keep a copy for every subset of
    # them, and code too long to be compiled.
    pairs = data.select(F.posexplode(F.array(*[F.col(c) for c in columns])).alias("_c", "_v")).where(F.col("_v").isNotNull())
    for r in _ranked_values(pairs, spans, dict(enumerate(counts)), probabilities, task_rows):
        out[columns[r["_c"]]][r["_j"]] = r["_q"]
    return out


def _spans(brackets: Sequence[tuple[float, float]]) -> list[list[float]]:
    """Brackets in order, those that meet as one; NaN is above all."""
    rank = lambda x: (x != x, x if x == x else 0.0)
    merged: list[list[float]] = []
    for low, high in sorted(brackets, key=lambda b: (rank(b[0]), rank(b[1]))):
        if merged and rank(low) <= rank(merged[-1][1]):
            merged[-1][1] = max(merged[-1][1], high, key=rank)
        else:
            merged.append([low, high])
    return merged


def column_statistics(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = GROUP_ACCURACY, task_rows: int = TASK_ROWS
) -> dict[str, dict[str, Any]]:
    """``n, mean, std, min, max`` and exact ``quantiles`` of any number of numeric columns, in two scans.

    The first scan holds the moments and a mergeable sketch of every column in one aggregation of (column, value) pairs. The second counts
    pairs by where they lie: between two brackets together, inside a bracket value by value. NULLs are ignored.
    """
    columns = list(columns)
    if not columns:
        return {}
    pairs = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_c", "_v")).where(F.col("_v").isNotNull())
    guard = 4.0 / accuracy
    points = sorted({min(1.0, max(0.0, float(p) + d)) for p in probabilities for d in (-guard, guard)})
    first = pairs.groupBy("_c").agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.percentile_approx("_v", points, accuracy).alias("s"),
    ).collect()
    out: dict[str, dict[str, Any]] = {c: {"n": 0, "mean": None, "std": None, "min": None, "max": None, "quantiles": [None] * len(probabilities)} for c in columns}
    spans: dict[int, list[list[float]]] = {}
    for r in first:
        out[columns[r["_c"]]].update({k: r[k] for k in ("n", "mean", "std", "min", "max")})
        spans[r["_c"]] = _spans([(r["s"][points.index(max(0.0, float(p) - guard))], r["s"][points.index(min(1.0, float(p) + guard))]) for p in probabilities])
    if not spans:
        return out
    for r in _ranked_values(pairs, spans, {r["_c"]: r["n"] for r in first}, probabilities, task_rows):
        out[columns[r["_c"]]]["quantiles"][r["_j"]] = r["_q"]
    return out


def _ranked_values(pairs: DataFrame, spans: Mapping[int, list[list[float]]], sizes: Mapping[int, int], probabilities: Sequence[float], task_rows: int) -> list[Any]:
    """(_c, _j, _q): the quantile of every column and probability, from counts around and inside the spans."""
    spark = pairs.sparkSession
    table = spark.createDataFrame([(c, [x for x, _ in s], [y for _, y in s]) for c, s in spans.items()], "_c int, _lows array<double>, _highs array<double>")
    passed = F.size(F.filter("_lows", lambda x: x <= F.col("_v")))
    inside = (F.col("_s") > 0) & (F.col("_v") <= F.try_element_at("_highs", F.col("_s")))
    placed = pairs.join(F.broadcast(table), "_c").withColumn("_s", passed).select("_c", "_s", F.when(inside, F.col("_v")).alias("_v"))
    counted = materialize(placed.groupBy("_c", "_s", "_v").agg(F.count(F.lit(1)).alias("_n")))
    spread: dict[int, dict[int, list[int]]] = {}  # column: span: rows inside it, rows between it and the next
    for r in counted.groupBy("_c", "_s").agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("i"), F.sum(F.when(F.col("_v").isNull(), F.col("_n"))).alias("o")).collect():
        spread.setdefault(r["_c"], {})[r["_s"]] = [r["i"] or 0, r["o"] or 0]
    wanted, missed = [], {}
    for c, found in spread.items():
        for j, p in enumerate(probabilities):
            position, before = (sizes[c] - 1) * float(p), found.get(0, [0, 0])[1]
            for span in range(1, len(spans[c]) + 1):
                here, after = found.get(span, [0, 0])
                if before <= math.floor(position) and math.ceil(position) < before + here:
                    wanted.append((c, j, span, position - before))
                    break
                before += here + after
            else:  # the sketch was off: all of the column is one span
                missed[c] = [[float("-inf"), float("nan")]]
    wanted = [w for w in wanted if w[0] not in missed]
    out = []
    if wanted:
        ranked = running_totals(counted.where(F.col("_v").isNotNull()), ["_c", "_s"], "_v", ["_n"], task_rows=task_rows)
        asked = spark.createDataFrame(wanted, "_c int, _j int, _s int, _at double")
        out += ranked.join(F.broadcast(asked), ["_c", "_s"]).groupBy("_c", "_j").agg(_interpolated("cum__n", "_v", F.col("_at")).alias("_q")).collect()
    if missed:
        out += _ranked_values(pairs.where(F.col("_c").isin(list(missed))), missed, sizes, probabilities, task_rows)
    return out


def cut_at(df: DataFrame, columns: Sequence[str], rank: int, task_rows: int = TASK_ROWS) -> Column:
    """Predicate true for the first ``rank`` rows in the order of ``columns`` (numbers, text or timestamps; NULLs last).

    Works one column at a time: the value at the rank is found, and only its ties go on to the next column. Rows equal in every column stay on one
    side. Each scan counts exactly how many rows lie below, at and between some sampled values and keeps the interval with the
    rank; an interval of at most ``task_rows`` rows is counted value by value, so nothing larger is ever sorted or moved.
    """
    level, left = df.select(*columns), int(rank)
    taken, tie = F.lit(False), F.lit(True)
    if left <= 0:
        return F.lit(False)
    for name in columns:
        present, rows = level.agg(F.count(name), F.count(F.lit(1))).first()
        if left > rows:
            return taken | tie
        if left > present:  # the cut lies among the NULLs, which come last
            value, below, ties = None, present, rows - present
        else:
            value, below, ties = _value_at(level.where(F.col(name).isNotNull()).select(name), name, left, present, task_rows)
        if value is None:
            before, same = F.col(name).isNotNull(), F.col(name).isNull()
        else:
            bound = F.lit(value)
            before, same = F.coalesce(F.col(name) < bound, F.lit(False)), F.col(name).eqNullSafe(bound)
        taken, tie = taken | (tie & before), tie & same
        left -= below
        if left >= ties:
            return taken | tie
        level = level.where(same)
    return taken | tie


def _value_at(data: DataFrame, name: str, rank: int, rows: int, task_rows: int) -> tuple[Any, int, int]:
    """(value at a rank from 1, rows below it, rows equal to it) of a column without NULLs."""
    column, below, inside, turn = F.col(name), 0, data, 0
    while rows > max(task_rows, 1):
        turn += 1
        drawn = {r[0] for r in inside.orderBy(F.rand(turn)).limit(16 * SPLITTERS).collect()}
        usable = sorted(v for v in drawn if v == v) or list(drawn)[:1]  # NaN comes last of all, and alone
        cuts = usable[:: -(-len(usable) // SPLITTERS)]
        listed = F.array(*[F.lit(v) for v in cuts])
        # 2k: above the first k values and below the next; 2k + 1: equal to the one after the first k
        place = F.size(F.filter(listed, lambda v: v < column)) + F.size(F.filter(listed, lambda v: v <= column))
        counts = {r["place"]: r["n"] for r in inside.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = below
        for spot in sorted(counts):
            if at + counts[spot] >= rank:
                break
            at += counts[spot]
        if spot % 2:
            return cuts[spot // 2], at, counts[spot]
        bounds = [column > F.lit(cuts[spot // 2 - 1])] if spot else []
        bounds += [column < F.lit(cuts[spot // 2])] if spot // 2 < len(cuts) else []
        inside = reduce(lambda frame, bound: frame.where(bound), bounds, inside)
        below, rows = at, counts[spot]
    counts = materialize(inside.groupBy(column.alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_totals(counts, [], "_v", ["_n"], rows=rows, task_rows=max(task_rows, rows))
    hit = ranked.where(F.col("cum__n") >= rank - below).agg(F.min(F.struct("cum__n", "_v", "_n")).alias("hit")).first()["hit"]
    return hit["_v"], below + hit["cum__n"] - hit["_n"], hit["_n"]
