"""Leak-aware, deterministic train/val/test splits by group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.text import split_group_key, stable_hash

#: Shares of the rows of a category, in order of preference for ties.
THREE_WAY = {"train": 0.8, "val": 0.1, "test": 0.1}
TWO_WAY = {"train": 0.9, "val": 0.1}


def phases(targets: list[float], counts: list[int], weight: int, n: int) -> list[tuple[int, list[int]]]:
    """The splits of `n` groups of one weight as (first rank, the splits that take turns from there on); `counts` grow by them.

    Each group goes to the split whose count lacks most of its target, the first of equals. Splits that would come before
    the leading one comes again take turns, each once a turn, until a further split has come level; so there are no more
    phases than splits.
    """
    out: list[tuple[int, list[int]]] = []
    lack = lambda s, picks=0: (targets[s] - (counts[s] + picks * weight), -s)
    done = 0
    while done < n:
        order = sorted(range(len(targets)), key=lack, reverse=True)
        turn = [s for s in order if s == order[0] or lack(s) > lack(order[0], 1)]
        left = n - done
        if rest := order[len(turn) :]:
            last, after = turn[-1], rest[0]
            turns = max(1, int((lack(last)[0] - lack(after)[0]) // weight))
            while turns > 1 and lack(last, turns - 1) < lack(after):
                turns -= 1
            while lack(last, turns) > lack(after):
                turns += 1
            left = min(left, turns * len(turn))
        out.append((done + 1, turn))
        for k, s in enumerate(turn):
            counts[s] += weight * ((left - k + len(turn) - 1) // len(turn))
        done += left
    return out


def deficit_runs(runs: pd.DataFrame, ratios: dict[str, float]) -> pd.DataFrame:
    """For runs of equal group weight (category, weight, n) the phases of each, heaviest run first (see `phases`)."""
    out = []
    names = list(ratios)
    for category, own in runs.sort_values(["category", "weight"], ascending=[True, False]).groupby("category", sort=False):
        total = int((own["weight"] * own["n"]).sum())
        targets, counts = [total * ratios[s] for s in names], [0] * len(names)
        for weight, n in zip(own["weight"], own["n"], strict=True):
            found = phases(targets, counts, int(weight), int(n))
            out.append((category, int(weight), [{"first": first, "turn": [names[s] for s in turn]} for first, turn in found]))
    return pd.DataFrame(out, columns=["category", "weight", "phases"])


def assign_group_splits(videos: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """(category, split_group, weight, split): groups by weight and md5, each to the split that lacks most rows.

    A group's rank among those of its weight is its rank in a range of the md5 plus the number of groups in the ranges
    before, so groups of one weight spread over tasks; its split follows from the rank and its weight's few phases. One
    row for each distinct weight of a category reaches the sequential step.
    """
    weights = videos.groupBy("category", "split_group").agg(F.count("*").alias("weight"))
    md5 = stable_hash("split_group")
    placed = weights.withColumns({"_md5": md5, "_range": F.substring(md5, 1, 2)})
    counts = placed.groupBy("category", "weight", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("category", "weight").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = counts.groupBy("category", "weight").agg(F.sum("_n").alias("n"))
    shares = ratios or THREE_WAY
    planned = runs.groupBy("category").applyInPandas(lambda own: deficit_runs(own, shares), "category string, weight long, phases array<struct<first:long,turn:array<string>>>")
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).join(planned, ["category", "weight"])
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("category", "weight", "_range").orderBy("_md5", "split_group")))
    joined = ranked.join(offsets, ["category", "weight", "_range"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    phase = F.element_at(F.filter("phases", lambda p: p["first"] <= F.col("_rank")), -1)
    split = F.element_at(phase["turn"], ((F.col("_rank") - phase["first"]) % F.size(phase["turn"]) + 1).cast("int"))
    return joined.select("category", "split_group", "weight", split.alias("split"))


def assign_splits(videos: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """(split_group, split): where several categories hold a group, the last category's split counts."""
    return assign_group_splits(videos, ratios).groupBy("split_group").agg(F.max_by("split", "category").alias("split"))


def apply_splits(videos: DataFrame, group_splits: DataFrame, official_test: DataFrame | None = None, all_test: bool = False) -> DataFrame:
    """Adds `split`: all test; or the official list to test and the rest by group; or all by group."""
    if all_test:
        return videos.withColumn("split", F.lit("test"))
    joined = videos.join(group_splits, "split_group", "left")
    if official_test is None:
        return joined
    listed = joined.join(official_test.select("video_path").distinct().withColumn("_listed", F.lit(True)), "video_path", "left")
    return listed.withColumn("split", F.when(F.col("_listed"), "test").otherwise(F.col("split"))).drop("_listed")


def with_split_group(videos: DataFrame) -> DataFrame:
    return videos.withColumn("split_group", split_group_key("category", "video_id"))
