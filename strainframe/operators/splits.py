"""Leak-free splits. Random order comes from md5(seed|group), the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainframe.plans.ordered import OrderedRuns
from strainframe.session import cut_lineage


def group_keys(rows: DataFrame, group: str, identity: str = "beatmap_id") -> DataFrame:
    """Adds ``split_group``; a blank group makes the row its own group."""
    text = F.col(group).cast("string")
    own = F.concat(F.lit("__row_"), F.col(identity).cast("string"))
    return rows.withColumn("split_group", F.when(text.isNull() | (text == ""), own).otherwise(text))


def has_groups(rows: DataFrame) -> bool:
    """Grouping needs three distinct groups."""
    return rows.select("split_group").distinct().limit(3).count() >= 3


def _shuffled(seed: int, value: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), value.cast("string")))


def _placed(frame: DataFrame, order: list[str]) -> DataFrame:
    runs = OrderedRuns.build(frame, [], order).indexed("_place")
    return runs.group_totals([], {"_size": ("sum", F.lit(1).cast("long"))}).rows()


def _share_labels(test: Column, val: Column) -> Column:
    train = F.col("_size") - val - test
    return (
        F.when(F.col("_place") < train, "train").when(F.col("_place") < train + val, "val").otherwise("test")
    )


def split_by_group(rows: DataFrame, *, seed: int) -> DataFrame:
    """80/10/10 by group; every group lands in exactly one part. Fewer than three groups are an error."""
    if not has_groups(rows):
        raise ValueError("a split by group needs at least three groups")
    groups = rows.select("split_group").distinct().withColumn("_order", _shuffled(seed, F.col("split_group")))
    tenth = F.greatest(F.lit(1), F.bround(F.col("_size") * F.lit(0.1), 0).cast("long"))
    part = F.when(tenth + tenth >= F.col("_size"), F.lit(1)).otherwise(tenth)
    placed = _placed(groups, ["_order", "split_group"])
    return rows.join(placed.select("split_group", _share_labels(part, part).alias("split")), "split_group")


def split_by_row(rows: DataFrame, *, seed: int, identity: str = "beatmap_id") -> DataFrame:
    """80/10/10 by row."""
    placed = _placed(rows.withColumn("_order", _shuffled(seed, F.col(identity))), ["_order", identity])
    train = F.floor(F.col("_size") * F.lit(0.8))
    val = F.floor(F.col("_size") * F.lit(0.9))
    label = F.when(F.col("_place") < train, "train").when(F.col("_place") < val, "val").otherwise("test")
    return placed.withColumn("split", label).drop("_place", "_size", "_order")


def dealing_plan(classes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, list[int]]]:
    """(size, place, order): from a place among the groups of one size on, the folds take turns in this order.

    ``classes`` holds (size, number of groups), largest size first. A group goes to
    the least loaded fold, the first of equals. Groups of one size fill the lowest
    folds in turns until these reach the next higher load, then one more fold takes
    part, so a size needs at most ``folds`` entries however many groups it has.
    """
    loads, plan = [0] * folds, []
    for size, count in classes:
        place, active = 0, 1
        while place < count:
            # The folds below the next load take turns; all of them lie within one size of each other.
            order = sorted(range(folds), key=lambda fold: (loads[fold], fold))
            turns, rest = order[:active], count - place
            if active < folds:
                limit = (loads[order[active]], order[active])
                fills = {f: max(0, -(-(limit[0] - loads[f] + (f < limit[1])) // size)) for f in turns}
                dealt = min(rest, sum(fills.values()))
            else:
                dealt = rest
            if dealt:
                plan.append((size, place, [fold + 1 for fold in turns]))
            for at, fold in enumerate(turns):
                loads[fold] += size * (dealt // active + (at < dealt % active))
            place += dealt
            active = min(folds, active + 1)
    return plan


def cross_validation_folds(rows: DataFrame, *, folds: int, seed: int, identity: str = "beatmap_id") -> DataFrame:
    """Adds ``fold`` 1..folds.

    Groups are dealt largest first, each to the least loaded fold. The loads follow
    from the number of groups of each size; n rows have at most sqrt(2n) different
    group sizes, so only these counts are planned on the driver. With fewer than
    three groups, or fewer than folds, the rows are dealt instead.
    """
    if folds < 2:
        raise ValueError("cross-validation needs at least two folds")
    if not has_groups(rows):
        return _row_folds(rows, folds, seed, identity)
    groups = cut_lineage(rows.groupBy("split_group").agg(F.count(F.lit(1)).alias("_rows")))
    if groups.limit(folds).count() < folds:
        return _row_folds(rows, folds, seed, identity)
    ordered = groups.withColumns({"_fewer": -F.col("_rows"), "_order": _shuffled(seed, F.col("split_group"))})
    placed = _placed(ordered, ["_fewer", "_order", "split_group"])
    classes = sorted(((r["_rows"], r["count"]) for r in groups.groupBy("_rows").count().collect()), reverse=True)
    starts, before = {}, 0
    for size, count in classes:
        starts[size], before = before, before + count
    plan = [(size, starts[size] + place, order) for size, place, order in dealing_plan(classes, folds)]
    turns = rows.sparkSession.createDataFrame(plan, "_rows long, _from long, _turns array<long>")
    # Per size the entries in rising order; the last one that starts at or before a group's place is its own.
    turns = turns.groupBy("_rows").agg(F.sort_array(F.collect_list(F.struct("_from", "_turns"))).alias("_plan"))
    own = F.element_at(F.filter("_plan", lambda entry: entry["_from"] <= F.col("_place")), -1)
    fold = F.get(own["_turns"], ((F.col("_place") - own["_from"]) % F.size(own["_turns"])).cast("int"))
    dealt = placed.join(turns, "_rows").select("split_group", fold.alias("fold"))
    # Groups grow with the rows: their files are small, but as a broadcast they would not be.
    return rows.join(dealt.hint("merge"), "split_group")


def _row_folds(rows: DataFrame, folds: int, seed: int, identity: str) -> DataFrame:
    placed = _placed(rows.withColumn("_order", _shuffled(seed, F.col(identity))), ["_order", identity])
    place, size = F.col("_place"), F.col("_size")
    base, extra = F.floor(size / folds), size % folds
    wide = extra * (base + 1)
    fold = F.when(place < wide, F.floor(place / (base + 1))).otherwise(extra + F.floor((place - wide) / base)) + 1
    return placed.withColumn("fold", fold.cast("long")).drop("_place", "_size", "_order")


def fold_rounds(rows: DataFrame, folds: int) -> DataFrame:
    """One copy of the rows per round: ``round`` and whether the row trains in it."""
    rounds = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(folds).cast("long")))
    return rows.withColumn("round", rounds).withColumn("is_train", F.col("fold") != F.col("round"))


def linear_baseline(
    rounds: DataFrame, keys: list[str], x: str, y: str, is_train: str, *, together: list[str] | None = None
) -> DataFrame:
    """Per key: intercept and slope of y ~ x on train rows, NULL when no baseline exists.

    No baseline: an unusable number anywhere in the columns used, fewer than two
    train rows, no evaluation row, or x constant. With ``together``, some of the
    keys, an unusable number spoils all keys that share them (all targets of a round).
    """
    train = F.col(is_train)
    xv, yv = F.col(x).try_cast("double"), F.col(y).try_cast("double")
    bad = lambda value: value.isNull() | F.isnan(value)
    fits = rounds.groupBy(*keys).agg(
        F.regr_slope(F.when(train, yv), F.when(train, xv)).alias("_slope"),
        F.regr_intercept(F.when(train, yv), F.when(train, xv)).alias("_intercept"),
        F.coalesce(F.sum((bad(xv) | (train & bad(yv))).cast("long")), F.lit(0)).alias("_bad"),
        F.sum(train.cast("long")).alias("_train"),
        F.sum((~train).cast("long")).alias("_eval"),
        F.stddev_pop(F.when(train, xv)).alias("_std"),
    )
    if together is not None:
        # One row per round and target here.
        fits = fits.withColumn("_bad", F.sum("_bad").over(Window.partitionBy(*together)))
    usable = (F.col("_bad") == 0) & (F.col("_train") >= 2) & (F.col("_eval") >= 1) & (F.col("_std") >= 1e-12)
    return fits.select(
        *keys,
        F.when(usable, F.col("_intercept")).alias("intercept"),
        F.when(usable, F.col("_slope")).alias("slope"),
    )


def mean_baseline(rounds: DataFrame, keys: list[str], y: str, is_train: str) -> DataFrame:
    """Per key: mean of y over train rows."""
    return rounds.groupBy(*keys).agg(F.avg(F.when(F.col(is_train), F.col(y))).alias("baseline"))
