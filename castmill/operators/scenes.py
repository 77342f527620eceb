"""Scenes of at most a given length, without recursion.

Splitting a range at its weakest boundary, again and again while a part is too long, visits the boundaries in
the order of their keys; so a boundary is a cut if and only if the range between its nearest smaller
neighbours is too long. A key is (not grammatical, similarity, position), smaller first.
"""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ends_sentence, starts_upper
from .transcripts import adjacent_similarity, build_scenes, scene_groups


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def parts_of(starts: pd.Series, ends: pd.Series, weak: pd.Series, sims: pd.Series, most: pd.Series) -> pd.Series:
    """Part number of each row of a group; nearest smaller keys by one pass with a stack."""

    def one(start, end, loose, sim, limit):
        n = len(start)
        key = [(bool(loose[i]), float(sim[i]), i) for i in range(n - 1)]
        left, right, stack = [0] * (n - 1), [n - 1] * (n - 1), []
        for i in range(n - 1):
            while stack and key[stack[-1]] > key[i]:
                right[stack.pop()] = i
            left[i] = stack[-1] + 1 if stack else 0
            stack.append(i)
        part, out = 0, []
        for i in range(n):
            out.append(part)
            part += i < n - 1 and end[right[i]] - start[left[i]] > limit
        return out

    return pd.Series([one(*row) for row in zip(starts, ends, weak, sims, most)])


def split_long_scenes(rows: DataFrame, key: str, order: str, most: float = 60.0) -> DataFrame:
    """rows (scene, start, end, text, sim to the next) with scene numbered anew, so that no scene of several rows is longer than most.

    Only scenes over the limit are gathered, one row each."""
    own, w = Window.partitionBy(key, "scene"), Window.partitionBy(key).orderBy(order)
    sized = rows.withColumns({"_long": F.max("end").over(own) - F.min("start").over(own) > most, "_weak": ~(ends_sentence("text") & F.coalesce(starts_upper(F.lead("text").over(w)), F.lit(False)))})
    item = F.struct(order, "start", "end", "_weak", F.coalesce("sim", F.lit(0.0)).alias("sim"))
    lists = sized.where("_long").groupBy(key, "scene").agg(F.array_sort(F.collect_list(item)).alias("_r"))
    part = parts_of("_r.start", "_r.end", "_r._weak", "_r.sim", F.lit(float(most)))
    cut = lists.select(key, "scene", F.explode(F.arrays_zip(F.col(f"_r.{order}").alias("o"), part.alias("part"))).alias("x")).select(key, "scene", F.col("x.o").alias(order), F.col("x.part").alias("_part"))
    dealt = sized.join(cut, [key, "scene", order], "left").withColumn("_part", F.coalesce("_part", F.lit(0)))
    new = F.coalesce(((F.col("scene") != F.lag("scene").over(w)) | (F.col("_part") != F.lag("_part").over(w))).cast("long"), F.lit(0))
    dealt = dealt.withColumn("_new", new)
    return dealt.withColumn("scene", F.sum("_new").over(w)).drop("_new", "_part", "_long", "_weak")


def scenes_of(rows: DataFrame, key: str, order: str, vector: str, least: float = 10.0, most: float = 60.0, guard: bool = True, keep_single: bool = False) -> DataFrame:
    """Scenes of rows with a vector each: grouped by falling similarity, split where longer than most, kept from `least` seconds on, times to hundredths.

    With keep_single, the one row of a key that has no other is a scene whatever its length."""
    grouped = scene_groups(adjacent_similarity(rows, key, order, vector), key, order, guard)
    if keep_single:
        every = build_scenes(split_long_scenes(grouped, key, order, most), key, order, 0.0)
        own = F.sum("n_lines").over(Window.partitionBy(key))
        found = every.withColumn("_rows", own).where((F.col("_rows") == 1) | (F.col("end") - F.col("start") >= least)).drop("_rows")
    else:
        found = build_scenes(split_long_scenes(grouped, key, order, most), key, order, least)
    return found.withColumns({"duration": F.round(F.col("end") - F.col("start"), 2), "start": F.round("start", 2), "end": F.round("end", 2)})
