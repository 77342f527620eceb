"""Registered queries over titles, splits, rankings and text helpers, each with its SQL."""

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import highlight as H
from ..operators import learning as L
from ..operators import pairs as P
from ..operators import titles as V
from ..operators import transcripts as R
from ..sources.stages import written
from .pairs import PAIRS, user_pairs
from .queries import EMBEDDED, LABELLED, SEGMENTS, SNAPSHOTS, _upper, embedded, labelled, snapshots, table, timed_segments


def bottom_titles(spark, d):
    return V.extreme_titles(labelled(spark, d), top=False).select("video_id", "title", F.round("viral_score", 6).alias("viral_score"))


def country_join(spark, d):
    """Countries of each video by a join, beside the count that the deduplication makes itself."""
    shots = V.cast_counts(snapshots(spark, d))
    fused = V.dedup_titles(shots).select("video_id", F.col("country_count").alias("fused_count"))
    return V.attach_country_count(shots).join(fused, "video_id").select("video_id", "country_count", "fused_count")


def published_titles(spark, d):
    """Last known day of publication by ascending views."""
    return V.dedup_titles(V.cast_counts(snapshots(spark, d))).select("video_id", "published")


def detector_rows(spark, d):
    return V.detector_rows(labelled(spark, d)).select("video_id", "viral_label")


def split_overlaps(spark, d):
    """Videos in more than one split: none."""
    return V.split_overlaps(V.stratified_split(labelled(spark, d))).select("video_id")


def split_coverage(spark, d):
    """Rows of all, of the splits, in several of them, and in none or unknown to all."""
    rows = written(labelled(spark, d))
    return V.split_coverage(V.stratified_split(rows), rows)


def usable_articles(spark, d, limit: int = 50):
    """The first documents that have a text and a source other than src3."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("article"), F.when(F.col("source") != "src3", F.col("source")).alias("highlights"))
    return P.usable_pairs(rows, limit).select("id", "highlights")


def scored_lines(spark, d):
    """Lines with relevancy to the mean vector of their document, and a detector's label and score from marks and capitals."""
    asks = (F.col("text").contains("?") | F.col("text").contains("!")).cast("int")
    rows = embedded(spark, d).select("doc_id", F.struct("pos", "vec", asks.alias("viral_label"), F.round(T.upper_ratio(F.col("text")), 4).alias("viral_score")).alias("r"))
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    own = own.withColumn("summary", N.mean_vector(F.transform("rows", lambda r: r["vec"])))
    near = lambda r: F.round(N.clip01(N.cosine(r["vec"], F.col("summary"))), 4)
    scored = F.transform("rows", lambda r: F.struct(r["pos"].alias("pos"), near(r).alias("relevancy"), r["viral_label"].alias("viral_label"), r["viral_score"].alias("viral_score")))
    return R.exploded(own, ["doc_id"], scored, "pos")


def relevant_lines(spark, d):
    return R.rank_relevant(scored_lines(spark, d), "doc_id", "pos", 3).select("doc_id", F.col("rank").cast("long").alias("rank"), "pos", "relevancy")


def highlight_lists(spark, d):
    """The relevant and the viral list of each document, with the number of its lines."""
    rows = written(scored_lines(spark, d))
    lists = [f(rows, "doc_id", "pos", 3).select("doc_id", F.lit(name).alias("list"), F.col("rank").cast("long").alias("rank"), "pos") for name, f in (("relevant", R.rank_relevant), ("viral", R.rank_viral))]
    n = rows.groupBy("doc_id").agg(F.count("*").alias("line_count"))
    return lists[0].unionByName(lists[1]).join(n, "doc_id")


def model_means(spark, d):
    """Sources as models: mean characters and words; by falling words."""
    docs = table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    return P.metric_means(docs.select("source", F.length("text").cast("double").alias("chars"), T.word_count("text").cast("double").alias("words")), "source", ["chars", "words"]).select("source", *[F.round(c, 4).alias(c) for c in ("chars", "words")])


def text_helpers(spark, d):
    """Markers, 64 first words, emoji or a default, and the joined text of each document's lines."""
    rows = timed_segments(spark, d)
    whole = rows.groupBy("doc_id").agg(T.join_text("pos", "text").alias("text"))
    return whole.select("doc_id", F.md5("text").alias("md5"), F.length(T.normalize_markers(F.concat(F.lit("<n> "), "text", F.lit("<n>")))).cast("long").alias("n_plain"), F.length(T.truncate_tokens(F.col("text"), 64)).cast("long").alias("n_cut"), T.extract_emoji("text", "-").alias("emoji"))


def worst_pairs(spark, d):
    """The five pairs of the largest word error rate; no SQL, as the rates have none."""
    return P.worst(P.error_rates(user_pairs(spark, d)).select("conv_id", "turn", F.round("wer", 6).alias("wer")))


def rouge_l(spark, d):
    return P.rouge_l(user_pairs(spark, d)).select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def meteor(spark, d):
    return P.meteor(user_pairs(spark, d)).select("conv_id", "turn", F.round("meteor", 6).alias("meteor"))


def highlight_models(spark, d):
    """Relevant and viral lines of all documents by models trained on the labelled titles; no SQL, as models have none."""
    train = written(labelled(spark, d))
    found = H.highlight_within(R.document_lines(table(spark, d, "documents")), "doc_id", "pos", L.train_detector(train), L.train_reranker(train))
    return found.select("doc_id", "list", F.col("rank").cast("long").alias("rank"), "pos", "relevancy", *[F.round(c, 6).alias(c) for c in ("viral_prob", "viral_score")], "line_count")


SCORED = f"""{EMBEDDED}, ex AS (SELECT doc_id, unnest(range(1, 65)) AS i, unnest(vec) AS v FROM emb), mv AS (SELECT doc_id, i, avg(v) AS v FROM ex GROUP BY 1, 2), mean AS (SELECT doc_id, list(v ORDER BY i) AS summary FROM mv GROUP BY 1),
sc AS (SELECT doc_id, pos, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(vec, summary))), 4) AS relevancy, (contains(text, '?') OR contains(text, '!'))::INT AS viral_label, round({_upper}, 4) AS viral_score FROM emb JOIN mean USING (doc_id))"""
_label = "CASE WHEN viral_score >= 0.75 THEN 1 WHEN viral_score <= 0.25 THEN 0 END"
_place = lambda c: f"row_number() OVER (PARTITION BY doc_id ORDER BY {c} DESC, pos)"
_emoji = r"[\x{10000}-\x{10FFFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}]"

ORACLE_SQL = {
    "bottom_titles": f"WITH {LABELLED} SELECT video_id, title, round(viral_score, 6) AS viral_score FROM scored ORDER BY scored.viral_score, category, video_id LIMIT 5",
    "country_join": f"WITH {LABELLED} SELECT video_id, country_count, country_count AS fused_count FROM dedup",
    "published_titles": f"WITH {SNAPSHOTS} SELECT video_id, arg_max(published, (CASE WHEN views IS NULL THEN 1 ELSE 0 END, coalesce(views, 0), country, published)) AS published FROM snap GROUP BY 1",
    "detector_rows": f"WITH {LABELLED} SELECT video_id, {_label} AS viral_label FROM scored WHERE {_label} IS NOT NULL",
    "split_overlaps": "SELECT l_partkey AS video_id FROM lineitem WHERE false",
    "split_coverage": f"WITH {LABELLED} SELECT count(*) AS n_all, count(DISTINCT video_id) AS n_split, 0::BIGINT AS n_overlap, 0::BIGINT AS n_missing, 0::BIGINT AS n_foreign FROM scored",
    "usable_articles": "SELECT doc_id AS id, source AS highlights FROM documents WHERE trim(coalesce(text, '')) <> '' AND source <> 'src3' ORDER BY doc_id LIMIT 50",
    # A row of the table of common subsequences is a list; a running maximum stands for the words left out.
    "rouge_l": f"""WITH RECURSIVE {PAIRS}, l AS (SELECT conv_id, turn, list_filter(string_split(reference, ' '), lambda w: w <> '') AS a, list_filter(string_split(hypothesis, ' '), lambda w: w <> '') AS b FROM p),
d AS (SELECT conv_id, turn, 0::BIGINT AS i, list_transform(range(0, len(b) + 1), lambda j: 0::BIGINT) AS r FROM l UNION ALL SELECT conv_id, turn, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(c[1:j])) FROM (SELECT d.*, b, list_prepend(0::BIGINT, list_transform(range(1, len(b) + 1), lambda j: greatest(r[j + 1], r[j] + CASE WHEN b[j] = a[i + 1] THEN 1 ELSE 0 END))) AS c FROM d JOIN l USING (conv_id, turn) WHERE i < len(a))),
e AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, r[-1] AS n FROM d JOIN l USING (conv_id, turn) WHERE i = len(a))
SELECT conv_id, turn, round(coalesce(n / nullif(nb, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(n / nullif(na, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * n / nullif(na + nb, 0)::DOUBLE, 0), 6) AS f1 FROM e""",
    "relevant_lines": f"WITH {SCORED} SELECT doc_id, {_place('relevancy')} AS rank, pos, relevancy FROM sc QUALIFY rank <= 3",
    "highlight_lists": f"WITH {SCORED}, n AS (SELECT doc_id, count(*) AS line_count FROM sc GROUP BY 1), l AS (SELECT doc_id, 'relevant' AS list, {_place('relevancy')} AS rank, pos FROM sc UNION ALL SELECT doc_id, 'viral', {_place('viral_score')}, pos FROM sc WHERE viral_label = 1) SELECT doc_id, list, rank, pos, line_count FROM l JOIN n USING (doc_id) WHERE rank <= 3",
    "model_means": r"SELECT source, round(avg(length(coalesce(text, ''))), 4) AS chars, round(avg(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''))), 4) AS words FROM documents GROUP BY source",
    "text_helpers": rf"""WITH {SEGMENTS}, j AS (SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS text FROM seg GROUP BY 1) SELECT doc_id, md5(text) AS md5, length(text) AS n_plain, length(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')[1:64], ' ')) AS n_cut, coalesce(nullif(array_to_string(regexp_extract_all(text, '{_emoji}'), ''), ''), '-') AS emoji FROM j""",
}
QUERIES = {n: globals()[n] for n in [*ORACLE_SQL, "worst_pairs", "meteor", "highlight_models"]}
