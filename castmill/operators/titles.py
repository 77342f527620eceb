"""Title snapshots: cleaning, one row per video, scores within category."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import engagement_rates
from ..functions.text import squash_ws, title_flags
from .metrics import ranked

COUNTS = ["views", "likes", "comments", "subscribers"]


def cast_counts(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in COUNTS})


def dedup_titles(df: DataFrame) -> DataFrame:
    """Per video: last known text columns by ascending views (null views last, then country, then the value), largest counts, countries."""
    order = lambda c: F.struct(F.col("views").isNull(), F.col("views"), F.col("country"), F.col(c))
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order(c))).alias(c) for c in ("title", "category", "published")]
    return df.where("video_id is not null").groupBy("video_id").agg(*last, *[F.max(c).alias(c) for c in COUNTS], F.count_distinct("country").alias("country_count"))


def clean_titles(df: DataFrame, min_views: float = 1000) -> DataFrame:
    df = df.withColumn("title", squash_ws("title")).dropna(subset=["title", "category", "views", "likes", "comments"])
    return df.where((F.col("title") != "") & (F.col("views") >= min_views))


def viral_labels(df: DataFrame, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """Average-tie percent rank of the engagement rate within the category, and its label."""
    df = ranked(df.withColumns(engagement_rates()), "engagement_rate", "category")
    sizes = df.groupBy("category").agg(F.count("engagement_rate").alias("_size"))
    df = df.join(sizes, "category").withColumn("viral_score", F.col("rank_engagement_rate") / F.col("_size")).drop("rank_engagement_rate", "_size")
    return df.withColumn("viral_label", F.when(F.col("viral_score") >= high, 1).when(F.col("viral_score") <= low, 0))


def title_features(df: DataFrame) -> DataFrame:
    return df.withColumns(title_flags("title"))


def stratified_split(df: DataFrame, seed: int = 42) -> DataFrame:
    """train, val, test at 80, 10 and 10 hundredths of each category, disjoint by video; of all rows where a category has under two."""
    sizes = df.groupBy("category").agg(F.count("*").alias("_size"))
    alone = sizes.where("_size < 2").isEmpty()
    df = df.withColumn("_own", F.col("category") if alone else F.lit("")).withColumn("_hash", F.xxhash64(F.lit(seed), "video_id").cast("double"))
    sizes = df.groupBy("_own").agg(F.count("*").alias("_size"))
    place = (F.col("rank__hash") - 0.5) / F.col("_size")
    rows = ranked(df, "_hash", "_own").join(sizes, "_own")
    return rows.withColumn("split", F.when(place < 0.8, "train").when(place < 0.9, "val").otherwise("test")).drop("_own", "_hash", "rank__hash", "_size")


def detector_rows(df: DataFrame) -> DataFrame:
    """Rows with a label, as an int."""
    return df.where("viral_label is not null").withColumn("viral_label", F.col("viral_label").cast("int"))


def attach_country_count(df: DataFrame) -> DataFrame:
    """Deduplicated titles with the number of their countries, by a join on the video; equal to the count within `dedup_titles`."""
    n = df.where("video_id is not null").groupBy("video_id").agg(F.count_distinct("country").alias("country_count"))
    return dedup_titles(df).drop("country_count").join(n, "video_id")


def extreme_titles(df: DataFrame, k: int = 5, top: bool = True) -> DataFrame:
    """The k titles of the largest (smallest) viral score; ties by category and video."""
    return df.orderBy(F.col("viral_score").desc() if top else F.col("viral_score"), "category", "video_id").limit(k)


def split_overlaps(rows: DataFrame, key: str = "video_id") -> DataFrame:
    """Ids that stand in more than one split; none where splits are disjoint."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def split_coverage(rows: DataFrame, all_rows: DataFrame, key: str = "video_id") -> DataFrame:
    """n_all, n_split (distinct ids), n_overlap (in several splits), n_missing (in none), n_foreign (in a split alone): the splits are disjoint and their union is all where the last three are 0."""
    own = rows.groupBy(key).agg(F.count_distinct("split").alias("_splits"))
    both = all_rows.select(key).distinct().withColumn("_own", F.lit(True)).join(own, key, "full_outer")
    return both.agg(F.count("_own").alias("n_all"), F.count("_splits").alias("n_split"), F.count_if(F.col("_splits") > 1).alias("n_overlap"), F.count_if(F.col("_splits").isNull()).alias("n_missing"), F.count_if(F.col("_own").isNull()).alias("n_foreign"))
