"""Registered queries over the given tables, each with its SQL equivalent.

Rates and scores are rounded to six places on both sides, so that the order of sums doesn't show.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import titles as V
from ..operators import transcripts as R


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Title snapshots from order lines: text counts, every 97th order without a readable view count."""
    li, s, n, p = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "part"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey)
    text = lambda c: F.col(c).cast("long").cast("string")
    views = F.when(F.col("l_orderkey") % 97 == 0, "n/a").otherwise(F.round("l_extendedprice").cast("long").cast("string"))
    return rows.select(F.col("l_partkey").alias("video_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.col("n_name").alias("country"), views.alias("views"), (F.col("l_quantity") * 10).cast("long").cast("string").alias("likes"), text("l_linenumber").alias("comments"), text("s_acctbal").alias("subscribers"), F.col("l_shipdate").cast("date").cast("string").alias("published"))


SNAPSHOTS = """snap AS (SELECT l_partkey AS video_id, p_name AS title, p_brand AS category, n_name AS country,
 try_cast(CASE WHEN l_orderkey % 97 = 0 THEN 'n/a' ELSE CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) END AS DOUBLE) AS views,
 CAST(trunc(l_quantity * 10) AS DOUBLE) AS likes, CAST(l_linenumber AS DOUBLE) AS comments, CAST(trunc(s_acctbal) AS DOUBLE) AS subscribers, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS published
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
LABELLED = f"""{SNAPSHOTS}, dedup AS (SELECT video_id, max(title) AS title, max(category) AS category, max(views) AS views, max(likes) AS likes, max(comments) AS comments, max(subscribers) AS subscribers, count(DISTINCT country) AS country_count FROM snap GROUP BY video_id),
clean AS (SELECT *, (likes + comments) / views AS engagement_rate FROM dedup WHERE views >= 1000 AND trim(title) <> ''),
scored AS (SELECT *, (rank() OVER (PARTITION BY category ORDER BY engagement_rate) + (count(*) OVER (PARTITION BY category, engagement_rate) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY category) AS viral_score FROM clean)"""


def labelled(spark, d):
    return V.viral_labels(V.clean_titles(V.dedup_titles(V.cast_counts(snapshots(spark, d)))))


def titles_dedup(spark, d):
    return V.dedup_titles(V.cast_counts(snapshots(spark, d))).select("video_id", "title", "category", "views", "likes", "comments", "subscribers", "country_count")


def viral_scores(spark, d):
    return labelled(spark, d).select("video_id", "category", *r6("like_rate", "comment_rate", "engagement_rate", "log_views", "viral_score"), "viral_label")


def label_counts(spark, d):
    return labelled(spark, d).groupBy("viral_label").agg(F.count("*").alias("n"))


def top_titles(spark, d):
    rows = labelled(spark, d)
    return rows.orderBy(F.col("viral_score").desc(), "category", "video_id").limit(5).select("video_id", "title", *r6("viral_score"))


def text_features(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("title"))
    return V.title_features(rows).drop("title").withColumn("upper_ratio", F.round("upper_ratio", 6))


SEGMENTS = r"""raw AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r\n|\r|\n'), lambda s: trim(s)), lambda s: s <> '') AS l, trim(text) AS t FROM documents),
sent AS (SELECT doc_id, CASE WHEN len(l) <= 1 THEN list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') ELSE l END AS l FROM raw),
good AS (SELECT doc_id, list_filter(l, lambda s: len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) >= 4) AS l FROM sent),
line AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM good),
timed AS (SELECT doc_id, pos, text, greatest(1.0::DOUBLE, round_even(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) / 2.5::DOUBLE, 0)) AS sec FROM line),
seg AS (SELECT doc_id, pos, text, sum(sec) OVER (PARTITION BY doc_id ORDER BY pos) - sec AS start, sum(sec) OVER (PARTITION BY doc_id ORDER BY pos) AS "end" FROM timed)"""


def timed_segments(spark, d):
    return R.segments(table(spark, d, "documents")).withColumn("pos", F.col("pos").cast("long"))


def captions(spark, d):
    rows = R.even_captions(timed_segments(spark, d), ["doc_id", "pos"])
    return rows.select("doc_id", "pos", "caption", *r6("start", "end"), "n_words")


def asr_text(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", T.asr_normalize(F.coalesce("text", F.lit(""))).alias("norm"))
    return c.where("norm <> ''").select("conv_id", "turn", "norm", F.size(F.split("norm", " ")).cast("long").alias("n_words"))


def clip_names(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return e.select("event_id", T.safe_clip_name(F.concat_ws(" ", "event_type", F.lit("no."), F.col("event_id").cast("string"))).alias("name"), *[T.timecode(F.col("value"), k).alias(k) for k in ("ass", "srt", "preview")])


def spans(spark, d):
    # Whole milliseconds, so that both engines round alike.
    start = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1000)
    return table(spark, d, "events").select(F.col("user_id").alias("recording_id"), (start / 1000).alias("start"), ((start + F.round(F.col("value") * 1000).cast("long")) / 1000).alias("end"))


def recordings(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("recording_id")).distinct().withColumn("total_dur", F.lit(2592000.0))


SPANS = """span AS (SELECT user_id AS recording_id, ((epoch_us(ts) - 1704067200000000) // 1000) / 1000.0::DOUBLE AS start, ((epoch_us(ts) - 1704067200000000) // 1000 + round(value * 1000)::BIGINT) / 1000.0::DOUBLE AS "end" FROM events)"""
ISLANDS = f"""{SPANS}, a AS (SELECT *, max("end") OVER (PARTITION BY recording_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM span),
b AS (SELECT *, sum(CASE WHEN start - last < 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM a),
isl AS (SELECT recording_id, min(start) AS start, max("end") AS "end" FROM b GROUP BY recording_id, island)"""


def merged_speech(spark, d):
    return I.merge_intervals(spans(spark, d), 3600.0)


def nonspeech(spark, d):
    return I.nonspeech_spans(spans(spark, d), recordings(spark, d), 7200.0, 60.0, 3600.0)


def speech_summary(spark, d):
    rows = I.merge_intervals(spans(spark, d), 3600.0).join(recordings(spark, d), "recording_id")
    return rows.groupBy("recording_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("speech"), F.round(F.sum(F.col("end") - F.col("start")) / F.max("total_dur"), 6).alias("ratio"), F.count("*").alias("n"))


def overlaps(spark, d):
    """Spans of one recording against clips: one clip per merged island, from its first minute on."""
    clips = I.merge_intervals(spans(spark, d), 3600.0).select("recording_id", (F.col("start") + 30).alias("span_start"), (F.col("end") - 10).alias("span_end"))
    return I.rebase_words(spans(spark, d), clips, "recording_id").select("recording_id", "span_start", "start", "end")


def bed_offsets(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", N.bed_duration(F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("value")), F.lit(5.0)).alias("dur"))
    return I.composition_offsets(e, "user_id", "event_id", "dur").select("user_id", "event_id", *r6("dur", "offset"))


EMOTION_OF = {"click": "joy", "purchase": "surprise", "error": "anger", "view": "neutral", "signup": "fear"}


def moods(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    points = spark.createDataFrame([(kind, *N.EMOTIONS[e]) for kind, e in EMOTION_OF.items()], "event_type string, v double, a double")
    e = e.join(F.broadcast(points), "event_type", "left").fillna(0.0, ["v", "a"])
    m = e.groupBy("user_id").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("valence"), (F.sum(F.col("n") * F.col("a")) / F.sum("n")).alias("arousal"))
    return m.withColumns({"valence": F.round("valence", 9), "arousal": F.round("arousal", 9)}).withColumn("mood", N.music_mood(F.col("valence"), F.col("arousal")))


def denoise(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") / 15).alias("snr"), (F.col("event_id") % 10 / 10).alias("flat"), F.col("value"))
    return e.select("event_id", N.denoise_strength(F.col("snr"), F.col("flat")).alias("strength"), F.round(N.gain(-F.col("value") / 10, F.lit(0.5)), 6).alias("gain"))


def audio(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 500).alias("x"), F.floor(F.col("event_id") / 500).alias("frame"))
    frames = e.groupBy(F.col("user_id").alias("recording_id"), "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "x"))), lambda s: s["x"]).alias("samples"))
    return M.audio_levels(frames, clip=0.5).select("recording_id", *r6("rms_db", "snr_db", "clipping_ratio"))


def scored(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = labels.join(docs, "doc_id").select("doc_id", "lang", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("target"), F.col("text"))
    return rows.select("doc_id", "lang", "label", "target", N.sigmoid((T.word_count("text") - 300) / 200).alias("prob"))


SCORED = r"""scored AS (SELECT d.doc_id, lang, quality AS label, n_chars::DOUBLE AS target, 1 / (1 + exp(-(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) - 300) / 200.0::DOUBLE)) AS prob FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def classifier_metrics(spark, d):
    return M.classification_metrics(scored(spark, d)).select(*r6("accuracy", "f1", "auc"))


def regression_metrics(spark, d):
    return M.spearman_mse(scored(spark, d), "target", "prob").select(F.round("spearman", 6).alias("spearman"), F.round("mse", 3).alias("mse"))


def ndcg(spark, d):
    return M.ndcg_at_k(scored(spark, d), "lang", "target", "prob").select("lang", *r6("ndcg"))


def embedded(spark, d):
    """Timed segments with a vector each, dealt over all vectors of the table."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))  # as stored; measures take doubles of it
    n = e.count()  # one number
    return timed_segments(spark, d).withColumn("vec_id", F.try_mod(F.col("doc_id") * 7 + F.col("pos") * 13, F.lit(n))).join(e, "vec_id")


def similar_lines(spark, d):
    rows = R.adjacent_similarity(embedded(spark, d), "doc_id", "pos", "vec")
    return rows.groupBy("doc_id").agg(F.round(F.avg("sim"), 6).alias("mean_sim"), F.round(F.stddev_pop("sim"), 6).alias("std_sim"), F.count("*").alias("n"))


def scenes(spark, d):
    rows = R.scene_groups(R.adjacent_similarity(embedded(spark, d), "doc_id", "pos", "vec"), "doc_id", "pos")
    return R.build_scenes(rows, "doc_id", "pos").select("doc_id", "scene", "start", "end", "n_lines", F.length("text").cast("long").alias("n_chars"))


def highlight(spark, d, k: int = 5, alpha: float = 0.5):
    """Lists by relevancy (cosine to the document's first vector), virality and both, k lines each."""
    rows = R.score_against_summary(embedded(spark, d).withColumn("summary", F.first("vec").over(Window.partitionBy("doc_id").orderBy("pos"))).where("summary is not null"), "vec", "summary")
    rows = rows.withColumn("virality", F.round(T.upper_ratio(F.col("text")), 4))
    each = R.rank_three(rows, "doc_id", "pos", k, alpha)
    return each.join(rows.select("doc_id", "pos", F.substring("text", 1, 100).alias("text")), ["doc_id", "pos"]).select("doc_id", "list", "rank", "pos", "score", "text")


def splits(spark, d):
    rows = V.stratified_split(labelled(spark, d))
    return rows.groupBy("category", "split").agg(F.count("*").alias("n"))


EMBEDDED = f"""{SEGMENTS}, emb AS (SELECT seg.*, embedding::DOUBLE[] AS vec FROM seg JOIN embeddings ON vec_id = (doc_id * 7 + pos * 13) % (SELECT count(*) FROM embeddings))"""
SIMS = f"""{EMBEDDED}, sims AS (SELECT *, list_cosine_similarity(vec, lead(vec) OVER (PARTITION BY doc_id ORDER BY pos)) AS sim, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM emb)"""
_cut = """CASE WHEN sim < avg(sim) OVER (PARTITION BY doc_id) - 0.5 * stddev_pop(sim) OVER (PARTITION BY doc_id) AND regexp_matches(text, '[.?!]$') AND regexp_matches(nxt, '^\\p{Lu}') THEN 1 ELSE 0 END"""
_rank = "row_number() OVER (PARTITION BY doc_id, list ORDER BY score DESC, pos)"
_upper = "length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / greatest(length(text), 1)::DOUBLE"
_code = lambda unit: f"CAST(round(value * {unit}) AS BIGINT)"

ORACLE_SQL = {
    "titles_dedup": f"WITH {LABELLED} SELECT video_id, title, category, views, likes, comments, subscribers, country_count FROM dedup",
    "viral_scores": f"WITH {LABELLED} SELECT video_id, category, round(likes / views, 6) AS like_rate, round(comments / views, 6) AS comment_rate, round(engagement_rate, 6) AS engagement_rate, round(ln(1 + views), 6) AS log_views, round(viral_score, 6) AS viral_score, CASE WHEN viral_score >= 0.75 THEN 1 WHEN viral_score <= 0.25 THEN 0 END AS viral_label FROM scored",
    "label_counts": f"WITH {LABELLED} SELECT CASE WHEN viral_score >= 0.75 THEN 1 WHEN viral_score <= 0.25 THEN 0 END AS viral_label, count(*) AS n FROM scored GROUP BY 1",
    "top_titles": f"WITH {LABELLED} SELECT video_id, title, round(viral_score, 6) AS viral_score FROM scored ORDER BY scored.viral_score DESC, category, video_id LIMIT 5",
    "text_features": rf"SELECT doc_id, length(text)::INT AS title_char_len, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::INT AS title_word_count, regexp_matches(text, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{1F1E6}}-\x{{1F1FF}}]') AS has_emoji, contains(text, '#') AS has_hashtag, regexp_matches(text, '\d') AS has_number, contains(text, '?') AS has_question, contains(text, '!') AS has_exclaim, round({_upper}, 6) AS upper_ratio FROM documents",
    "timed_segments": f'WITH {SEGMENTS} SELECT doc_id, pos, text, start, "end" FROM seg',
    "captions": rf"""WITH {SEGMENTS}, w AS (SELECT doc_id, pos, start, "end", len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n, unnest(range(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')))) AS k FROM seg) SELECT doc_id, pos, k // 3 AS caption, round(min(start + k * (("end" - start) / n)), 6) AS start, round(max(start + (k + 1) * (("end" - start) / n)), 6) AS "end", count(*) AS n_words FROM w GROUP BY doc_id, pos, k // 3""",
    "asr_text": r"WITH a AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '\p{P}', '', 'g'), '\s+', ' ', 'g')) AS norm FROM conversations) SELECT conv_id, turn, norm, len(string_split(norm, ' '))::BIGINT AS n_words FROM a WHERE norm <> ''",
    "clip_names": f"SELECT event_id, replace(event_type || ' no ' || event_id, ' ', '_') AS name, format('{{:d}}:{{:02d}}:{{:02d}}.{{:02d}}', {_code(100)} // 360000, {_code(100)} // 6000 % 60, {_code(100)} // 100 % 60, {_code(100)} % 100) AS ass, format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {_code(1000)} // 3600000, {_code(1000)} // 60000 % 60, {_code(1000)} // 1000 % 60, {_code(1000)} % 1000) AS srt, format('{{:02d}}:{{:02d}}.{{:02d}}', {_code(100)} // 6000, {_code(100)} // 100 % 60, {_code(100)} % 100) AS preview FROM events",
    "merged_speech": f'WITH {ISLANDS} SELECT recording_id, start, "end" FROM isl',
    "nonspeech": f"""WITH {ISLANDS}, e AS (SELECT * FROM isl UNION ALL SELECT DISTINCT user_id, 2592000.0::DOUBLE, 2592000.0::DOUBLE FROM events),
g AS (SELECT recording_id, coalesce(max("end") OVER (PARTITION BY recording_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS s, start AS e FROM e)
SELECT recording_id, round(s + 60, 3) AS start, round(e - 60, 3) AS "end" FROM g WHERE e > s AND (e - 60) - (s + 60) >= 7200""",
    "speech_summary": f'WITH {ISLANDS} SELECT recording_id, round(sum("end" - start), 3) AS speech, round(sum("end" - start) / 2592000.0::DOUBLE, 6) AS ratio, count(*) AS n FROM isl GROUP BY recording_id',
    "overlaps": f"""WITH {ISLANDS}, c AS (SELECT recording_id, start + 30 AS span_start, "end" - 10 AS span_end FROM isl WHERE "end" - 10 >= start + 30)
SELECT c.recording_id, span_start, round(greatest(start, span_start) - span_start, 3) AS start, round(least("end", span_end) - span_start, 3) AS "end" FROM span JOIN c ON c.recording_id = span.recording_id AND start < span_end AND "end" > span_start
WHERE "end" <= start OR (least("end", span_end) - greatest(start, span_start)) / ("end" - start) >= 0.5""",
    "bed_offsets": "WITH a AS (SELECT user_id, event_id, least(15.0::DOUBLE, greatest(2.0::DOUBLE, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE value END, 0), 5.0::DOUBLE))) AS dur FROM events) SELECT user_id, event_id, round(dur, 6) AS dur, round(coalesce(sum(dur) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE), 6) AS offset FROM a",
    "moods": """WITH p AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0.8 WHEN 'purchase' THEN 0.4 WHEN 'error' THEN -0.6 WHEN 'signup' THEN -0.7 ELSE 0 END::DOUBLE AS v, CASE event_type WHEN 'click' THEN 0.6 WHEN 'purchase' THEN 0.7 WHEN 'view' THEN 0 ELSE 0.8 END::DOUBLE AS a FROM events),
m AS (SELECT user_id, round(avg(v), 9) AS valence, round(avg(a), 9) AS arousal FROM p GROUP BY user_id)
SELECT user_id, valence, arousal, CASE WHEN abs(valence) < 0.15 AND abs(arousal) < 0.2 THEN 'calm' WHEN valence >= 0 AND arousal >= 0 THEN 'bright' WHEN valence >= 0 THEN 'peaceful' WHEN arousal >= 0 THEN 'dark' ELSE 'melancholic' END AS mood FROM m""",
    "denoise": """WITH a AS (SELECT event_id, value, CASE WHEN value / 15 >= 20 THEN 0 WHEN value / 15 >= 10 THEN 1 ELSE 2 END AS s, CASE WHEN event_id % 10 / 10.0::DOUBLE < 0.3 THEN 0 WHEN event_id % 10 / 10.0::DOUBLE < 0.6 THEN 1 ELSE 2 END AS f FROM events)
SELECT event_id, ['none', 'mild', 'strong'][1 + CASE WHEN s >= 1 AND f >= 1 THEN least(greatest(s, f) + 1, 2) ELSE greatest(s, f) END] AS strength, round(CASE WHEN 0.5 * pow(10, (-23 + value / 10) / 20) > 0.99 THEN 0.99 / 0.5::DOUBLE ELSE pow(10, (-23 + value / 10) / 20) END, 6) AS gain FROM events JOIN a USING (event_id, value)""",
    "audio": """WITH f AS (SELECT user_id AS recording_id, event_id // 500 AS frame, sum(value / 500 * (value / 500)) AS sq, count(*) AS n, count(*) FILTER (value / 500 >= 0.5) AS hot FROM events GROUP BY 1, 2),
r AS (SELECT *, sqrt(sq / n) AS rms FROM f), l AS (SELECT recording_id, quantile_cont(rms, 0.1) AS low, max(rms) AS top FROM r GROUP BY 1),
m AS (SELECT recording_id, sqrt(sum(sq) / sum(n)) AS rms, sum(hot) / sum(n)::DOUBLE AS clipping_ratio, greatest(avg(rms * rms) FILTER (rms <= low), 1e-10) AS noise, avg(rms * rms) FILTER (rms > low) AS signal FROM r JOIN l USING (recording_id) GROUP BY 1)
SELECT recording_id, round(20 * log10(rms), 6) AS rms_db, round(CASE WHEN signal IS NULL THEN -60.0::DOUBLE ELSE greatest(-60, least(100, 10 * log10(signal / noise))) END, 6) AS snr_db, round(clipping_ratio, 6) AS clipping_ratio FROM m""",
    "classifier_metrics": f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS k FROM scored)
SELECT round(avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(2.0::DOUBLE * count(*) FILTER (prob >= 0.5 AND label = 1) / (count(*) FILTER (prob >= 0.5) + count(*) FILTER (label = 1)), 6) AS f1, round((sum(k) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)), 6) AS auc FROM r""",
    "regression_metrics": f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS p, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0::DOUBLE AS t FROM scored) SELECT round(corr(p, t), 6) AS spearman, round(avg((target - prob) * (target - prob)), 3) AS mse FROM r""",
    "ndcg": f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY prob DESC) AS kp, row_number() OVER (PARTITION BY lang ORDER BY target DESC) AS kt, avg(target) OVER (PARTITION BY lang, prob) AS ap FROM scored)
SELECT lang, round(sum(CASE WHEN kp <= 10 THEN ap / log2(kp + 1) ELSE 0 END) / sum(CASE WHEN kt <= 10 THEN target / log2(kt + 1) ELSE 0 END), 6) AS ndcg FROM r GROUP BY lang""",
    "similar_lines": f"WITH {SIMS} SELECT doc_id, round(avg(sim), 6) AS mean_sim, round(stddev_pop(sim), 6) AS std_sim, count(*) AS n FROM sims GROUP BY doc_id",
    "scenes": f"""WITH {SIMS}, c AS (SELECT *, {_cut} AS cut FROM sims), g AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS scene FROM c)
SELECT doc_id, scene, min(start) AS start, max("end") AS "end", count(*) AS n_lines, (sum(length(text)) + count(*) - 1)::BIGINT AS n_chars FROM g GROUP BY doc_id, scene HAVING max("end") - min(start) >= 10""",
    "highlight": f"""WITH {EMBEDDED}, f AS (SELECT doc_id, vec AS summary FROM emb WHERE pos = 0), s AS (SELECT doc_id, pos, substr(text, 1, 100) AS t, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(vec, summary))), 4) AS relevancy, round({_upper}, 4) AS virality FROM emb JOIN f USING (doc_id)),
u AS (SELECT doc_id, pos, t, 'relevancy' AS list, relevancy AS score FROM s UNION ALL SELECT doc_id, pos, t, 'virality', virality FROM s UNION ALL SELECT doc_id, pos, t, 'combined', round(0.5 * relevancy + 0.5 * virality, 5) FROM s)
SELECT doc_id, list, {_rank} AS rank, pos, score, t AS text FROM u QUALIFY {_rank} <= 5""",
    "splits": f"""WITH {LABELLED}, c AS (SELECT category, count(*) AS m FROM scored GROUP BY 1), k AS (SELECT category, m, unnest(range(m)) AS i FROM c)
SELECT category, CASE WHEN (i + 0.5::DOUBLE) / m < 0.8 THEN 'train' WHEN (i + 0.5::DOUBLE) / m < 0.9 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM k GROUP BY 1, 2""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
#: Second names of the same queries, kept as they were once registered.
QUERIES |= {f"{q.__name__}_whole": q for q in (similar_lines, scenes, highlight)}
ORACLE_SQL |= {f"{n}_whole": ORACLE_SQL[n] for n in ("similar_lines", "scenes", "highlight")}
