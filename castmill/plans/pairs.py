"""Registered queries over conversations and lines: validation, alignment, error rates, overlap, captions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pairs as P
from ..operators import transcripts as R
from .queries import SEGMENTS, table, timed_segments

LEAST_CHARS = 40


def _plain(c):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))


def turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def user_pairs(spark, d):
    """Each user turn with the assistant turn after it, as plain words."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns(spark, d).withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w)})
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", _plain(F.col("text")).alias("reference"), _plain(F.col("next_text")).alias("hypothesis"))


_sql_plain = lambda c: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
PAIRS = f"""u AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, {_sql_plain("text")} AS reference, {_sql_plain("next_text")} AS hypothesis FROM u WHERE role = 'user' AND next_role = 'assistant')"""


def requests(spark, d):
    """Turns as summary requests: kept (null reason) or rejected."""
    n = F.length(F.trim("text"))
    return turns(spark, d).select("conv_id", "turn", F.when(n == 0, "empty_text").when(n < LEAST_CHARS, "short_transcript").alias("reason"))


REQUESTS = f"req AS (SELECT conv_id, turn, CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'empty_text' WHEN length(trim(coalesce(text, ''))) < {LEAST_CHARS} THEN 'short_transcript' END AS reason FROM conversations)"


def reject_counts(spark, d):
    return requests(spark, d).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def search_lines(spark, d, q: str = "LICENSE"):
    """Lines that hold q in either case."""
    return timed_segments(spark, d).where(F.lower("text").contains(q.lower())).select("doc_id", "pos", "text")


def nested_words(spark, d):
    """Turns with their words; those of assistants have no word rows."""
    rows = turns(spark, d)
    w = rows.where("role <> 'assistant'").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("pos", "word"))
    nested = P.nest_words(rows, w, ["conv_id", "turn"], "pos")
    return nested.select("conv_id", "turn", F.size("words").cast("long").alias("n_words"), F.try_element_at("words", F.lit(-1))["word"].alias("last_word"))


def aligned_turns(spark, d):
    """User and assistant turns by position, with the reason where their counts differ."""
    rows = turns(spark, d)
    found = P.align_segments(rows.where("role = 'user'"), rows.where("role = 'assistant'"), "conv_id", "turn")
    return found.select("conv_id", F.col("pos").cast("long").alias("pos"), F.length("reference").cast("long").alias("n_reference"), F.length("hypothesis").cast("long").alias("n_hypothesis"), "n_left", "n_right", "reason")


def char_errors(spark, d):
    """Edits between the characters of each pair, and their share of the reference."""
    e = F.levenshtein("reference", "hypothesis").cast("long")
    return user_pairs(spark, d).select("conv_id", "turn", e.alias("edits"), F.round(F.try_divide(e, F.length("reference")), 6).alias("cer"))


def word_errors(spark, d):
    return P.error_rates(user_pairs(spark, d)).select("conv_id", "turn", "substitutions", "deletions", "insertions", "hits", F.round("wer", 6).alias("wer"))


def wer_report(spark, d):
    return P.wer_report(P.error_rates(user_pairs(spark, d)), "conv_id").select("conv_id", F.round("wer_hits", 6).alias("wer_hits"), F.round("wer", 6).alias("wer"))


def word_edits(spark, d):
    """Least edits of each pair and of each conversation's pairs together (turn null)."""
    rates = P.error_rates(user_pairs(spark, d))
    edits = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    each = rates.groupBy("conv_id", "turn").agg(F.sum(edits).alias("edits"), F.sum("n_reference").alias("n_reference"))
    total = P.wer_report(rates, "conv_id").join(rates.groupBy("conv_id").agg(F.sum(edits).alias("edits"), F.sum("n_reference").alias("n_reference")), "conv_id")
    return each.select("conv_id", "turn", "edits", "n_reference", F.round(F.try_divide("edits", "n_reference"), 6).alias("wer")).union(total.select("conv_id", F.lit(None), "edits", "n_reference", F.round("wer", 6)))


def _rouge(n):
    def rouge(spark, d):
        return P.rouge_n(user_pairs(spark, d), ["conv_id", "turn"], n).select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])

    return rouge


def _sql_rouge(n: int) -> str:
    side = lambda c, x: f"SELECT conv_id, turn, gram, count(*) AS {x} FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS gram FROM (SELECT conv_id, turn, string_split({c}, ' ') AS t FROM p WHERE {c} <> '')) GROUP BY ALL"
    return f"""WITH {PAIRS}, a AS ({side("reference", "a")}), b AS ({side("hypothesis", "b")}),
s AS (SELECT conv_id, turn, sum(least(coalesce(a, 0), coalesce(b, 0))) AS same, sum(coalesce(a, 0)) AS a, sum(coalesce(b, 0)) AS b FROM a FULL JOIN b USING (conv_id, turn, gram) GROUP BY 1, 2)
SELECT conv_id, turn, round(coalesce(same::DOUBLE / nullif(b, 0), 0), 6) AS precision, round(coalesce(same::DOUBLE / nullif(a, 0), 0), 6) AS recall, round(coalesce(2 * same::DOUBLE / nullif(a + b, 0), 0), 6) AS f1 FROM p LEFT JOIN s USING (conv_id, turn)"""


def source_table(spark, d):
    """A row per source: mean characters and words, and documents with a question."""
    docs = table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    each = {"chars": F.length("text"), "words": T.word_count("text"), "asks": F.col("text").contains("?").cast("int")}
    rows = docs.select("source", F.explode(F.create_map(*[x for k, c in each.items() for x in (F.lit(k), c.cast("double"))])).alias("metric", "value"))
    return P.comparison_table(rows, "source", "metric", "value", list(each))


def srt(spark, d):
    """One caption file per document."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    cue = F.concat_ws("\n", F.row_number().over(w).cast("string"), F.concat(T.timecode(F.col("start"), "srt"), F.lit(" --> "), T.timecode(F.col("end"), "srt")), "text")
    cues = timed_segments(spark, d).select("doc_id", "pos", cue.alias("cue"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cue"))), lambda x: x["cue"]), "\n\n")
    return cues.groupBy("doc_id").agg(F.md5(whole).alias("srt_md5"), F.count("*").alias("n_cues"))


def rank_viral(spark, d, k: int = 5):
    """Up to k lines a document that ask or exclaim, by share of capitals."""
    rows = timed_segments(spark, d).where("contains(text, '!') or contains(text, '?')").withColumn("score", F.round(T.upper_ratio(F.col("text")), 4))
    return R.top_k(rows, "doc_id", "score", "pos", k).select("doc_id", F.col("rank").cast("long").alias("rank"), "pos", "score")


_time = lambda c: f"format('{{:02d}}:{{:02d}}:{{:02d}},000', {c}::BIGINT // 3600, {c}::BIGINT // 60 % 60, {c}::BIGINT % 60)"
QUERIES = {
    "requests": requests, "reject_counts": reject_counts, "search_lines": search_lines, "nested_words": nested_words, "aligned_turns": aligned_turns,
    "char_errors": char_errors, "word_errors": word_errors, "wer_report": wer_report, "word_edits": word_edits, "rouge1": _rouge(1), "rouge2": _rouge(2),
    "char_errors_whole": char_errors, "rouge1_whole": _rouge(1), "rouge2_whole": _rouge(2),  # second names, kept as they were once registered
    "source_table": source_table, "srt": srt, "rank_viral": rank_viral,
}
ORACLE_SQL = {
    "requests": f"WITH {REQUESTS} SELECT * FROM req",
    "reject_counts": f"WITH {REQUESTS} SELECT reason, count(*) AS n FROM req WHERE reason IS NOT NULL GROUP BY 1",
    "search_lines": f"WITH {SEGMENTS} SELECT doc_id, pos, text FROM seg WHERE contains(lower(text), 'license')",
    "nested_words": "SELECT conv_id, turn, CASE WHEN role <> 'assistant' THEN len(w) ELSE 0 END::BIGINT AS n_words, CASE WHEN role <> 'assistant' THEN w[-1] END AS last_word FROM (SELECT conv_id, turn, role, text, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations) WHERE trim(text) <> ''",
    "aligned_turns": """WITH n AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS pos FROM conversations),
j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS pos, length(a.text) AS n_reference, length(b.text) AS n_hypothesis FROM (SELECT * FROM n WHERE role = 'user') a FULL JOIN (SELECT * FROM n WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.pos = b.pos),
c AS (SELECT *, count(n_reference) OVER (PARTITION BY conv_id) AS n_left, count(n_hypothesis) OVER (PARTITION BY conv_id) AS n_right FROM j)
SELECT *, CASE WHEN n_left <> n_right THEN 'unequal_counts' END AS reason FROM c""",
    "char_errors": f"WITH {PAIRS} SELECT conv_id, turn, levenshtein(reference, hypothesis)::BIGINT AS edits, round(levenshtein(reference, hypothesis) / nullif(length(reference), 0)::DOUBLE, 6) AS cer FROM p",
    # A row of the edit table is a list; a running minimum stands for the insertions.
    "word_edits": f"""WITH RECURSIVE {PAIRS}, l AS (SELECT conv_id, turn, list_filter(string_split(reference, ' '), lambda w: w <> '') AS a, list_filter(string_split(hypothesis, ' '), lambda w: w <> '') AS b FROM p),
d AS (SELECT conv_id, turn, 0::BIGINT AS i, range(0, len(b) + 1) AS r FROM l UNION ALL SELECT conv_id, turn, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_min(adj[1:j]) + j) FROM (SELECT d.*, b, list_transform(list_prepend(i + 1, list_transform(range(1, len(b) + 1), lambda j: least(r[j + 1] + 1, r[j] + CASE WHEN b[j] = a[i + 1] THEN 0 ELSE 1 END))), lambda v, k: v - k) AS adj FROM d JOIN l USING (conv_id, turn) WHERE i < len(a))),
c AS (SELECT conv_id, turn, len(a) AS n, r[-1] AS e FROM d JOIN l USING (conv_id, turn) WHERE i = len(a))
SELECT conv_id, turn, sum(e)::BIGINT AS edits, sum(n)::BIGINT AS n_reference, round(sum(e) / nullif(sum(n), 0)::DOUBLE, 6) AS wer FROM c GROUP BY GROUPING SETS ((conv_id, turn), (conv_id))""",
    "rouge1": _sql_rouge(1),
    "rouge2": _sql_rouge(2),
    "source_table": r"SELECT source, round(avg(length(coalesce(text, ''))), 4) AS chars, round(avg(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''))), 4) AS words, round(avg(contains(coalesce(text, ''), '?')::INT), 4) AS asks FROM documents GROUP BY source",
    "srt": f"""WITH {SEGMENTS}, c AS (SELECT doc_id, pos, concat_ws(chr(10), row_number() OVER (PARTITION BY doc_id ORDER BY pos)::VARCHAR, {_time("start")} || ' --> ' || {_time('"end"')}, text) AS cue FROM seg) SELECT doc_id, md5(string_agg(cue, chr(10) || chr(10) ORDER BY pos)) AS srt_md5, count(*) AS n_cues FROM c GROUP BY doc_id""",
    "rank_viral": rf"""WITH {SEGMENTS}, s AS (SELECT doc_id, pos, round(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / greatest(length(text), 1)::DOUBLE, 4) AS score FROM seg WHERE contains(text, '!') OR contains(text, '?')) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank, pos, score FROM s QUALIFY rank <= 5""",
}
ORACLE_SQL |= {f"{n}_whole": ORACLE_SQL[n] for n in ("char_errors", "rouge1", "rouge2")}
