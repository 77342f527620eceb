"""Highlights of transcripts: checked requests, and the relevant and viral lines of each transcript by models."""

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip01, dot
from ..functions.text import truncate_tokens
from ..sources.stages import written
from .learning import fit_encoder, score_detector, score_reranker
from .summaries import gathered, summarize_within
from .transcripts import rank_viral

LEAST_TRANSCRIPT, LEAST_MOOD = 40, 4


def validate_requests(rows: DataFrame) -> DataFrame:
    """rows (kind transcript, mood or clip) with reason, null for those that hold."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    spoken = F.col("kind").isin("transcript", "mood")
    reason = (
        F.when(spoken & (n == 0), "empty_text").when((F.col("kind") == "transcript") & (n < LEAST_TRANSCRIPT), "short_transcript")
        .when((F.col("kind") == "mood") & (n < LEAST_MOOD), "short_mood_text").when((F.col("kind") == "clip") & ~F.coalesce(F.col("end") > F.col("start"), F.lit(False)), "empty_span")
    )
    return rows.withColumn("reason", reason)


def highlight(lines: DataFrame, key: str, order: str, detector: PipelineModel, reranker: PipelineModel, k: int = 5, max_tokens: int = 64, titles: DataFrame | None = None) -> DataFrame:
    """highlight_within of lines that come as rows."""
    return highlight_within(gathered(lines.select(key, order, "text"), key, order), key, order, detector, reranker, k, max_tokens, titles)


def highlight_within(docs: DataFrame, key: str, order: str, detector: PipelineModel, reranker: PipelineModel, k: int = 5, max_tokens: int = 64, titles: DataFrame | None = None) -> DataFrame:
    """key, list (relevant or viral), rank, order, relevancy, viral_prob, viral_label, viral_score, line_count, of docs (one row a key,
    its sentences an array of (order, text) in order).

    The summary of a transcript is extractive; it and the lines share one encoder. A line meets its summary's vector where
    its key's row is taken apart, so neither is shuffled or written. The detector sees the first max_tokens words of each line.
    Only lines that a list may hold reach the reranker: the k most relevant and those that the detector calls viral."""
    length = lambda v: F.sqrt(dot(v, v))
    docs = written(summarize_within(docs.select(key, "sentences"), key, order, titles=titles, keep=True).select(key, "sentences", F.when(F.col(key).isNotNull(), F.col("summary")).alias("summary")))
    texts = F.concat(F.transform("sentences", lambda x: x["text"]), F.array("summary"))
    encoder = fit_encoder(docs.select(F.explode(texts).alias("text")).where("text is not null"))
    docs = docs.where("summary is not null")
    own = encoder.transform(docs.withColumnRenamed("summary", "text")).withColumns({"_center": vector_to_array("_vec"), "_size": length(F.unwrap_udt("_vec")["values"])})
    lines = own.select(key, F.struct("_center", "_size").alias("_summary"), F.size("sentences").cast("long").alias("line_count"), F.inline("sentences"))
    vector = F.unwrap_udt("_vec")
    scored = encoder.transform(lines).withColumns({"_at": vector["indices"], "_values": vector["values"]})
    met = dot(F.col("_values"), F.transform("_at", lambda i: F.get(F.col("_summary._center"), i)))
    near = F.try_divide(met, length(F.col("_values")) * F.col("_summary._size"))
    scored = scored.select(key, order, truncate_tokens(F.col("text"), max_tokens).alias("title"), F.round(clip01(near), 4).alias("relevancy"), "line_count")
    first = Window.partitionBy(key).orderBy(F.desc("relevancy"), order)
    ranked = score_detector(detector, scored).withColumn("_rank", F.row_number().over(first))
    marked = written(score_reranker(reranker, ranked.where((F.col("_rank") <= max(1, k)) | (F.col("viral_label") == 1)), "viral_score").drop("title"))
    columns = [key, "list", "rank", order, "relevancy", "viral_prob", "viral_label", "viral_score", "line_count"]
    first = marked.where(F.col("_rank") <= max(1, k)).select("*", F.lit("relevant").alias("list"), F.col("_rank").alias("rank")).select(columns)
    second = rank_viral(marked, key, order, k).withColumn("list", F.lit("viral")).select(columns)
    return first.unionByName(second)
