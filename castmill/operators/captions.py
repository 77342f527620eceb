"""Captions: cues packed from words, word-by-word events, subtitle documents, gaps and numbering."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import let
from ..functions.text import timecode, wrap_text
from .folds import cue_numbers
from .transcripts import even_words, exploded


def next_gap(rows: DataFrame, key: str, order: str) -> DataFrame:
    """gap: start of the next row less the end of this one; null on the last."""
    return rows.withColumn("gap", F.lead("start").over(Window.partitionBy(key).orderBy(order)) - F.col("end"))


def renumber(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """id: 0-based place in the order, across chunks."""
    return rows.withColumn("id", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def cue_ids(words: DataFrame, key: str, order: str, max_chars: int = 84, max_seconds: float = 7.0, pause: float = 0.4) -> DataFrame:
    """words with cue: a new one before a word that makes it too wide or too long, after a sentence and before a pause.

    Sentences and pauses cut for certain; only the words between two such cuts are folded in order."""
    w = Window.partitionBy(key).orderBy(order)
    word = F.trim("word")
    sure = F.coalesce((F.lag(word).over(w).rlike(r"[.!?]$") | (F.col("start") - F.lag("end").over(w) >= pause)).cast("int"), F.lit(0))
    rows = words.withColumn("_sure", sure).withColumn("_run", F.sum("_sure").over(w))
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*[c for c in words.columns if c != key], F.length(word).alias("_size")).alias("r"))))
    runs = rows.groupBy(key, "_run").agg(F.transform(each, lambda x: x["r"]).alias("_w"))
    runs = runs.withColumn("_cue", cue_numbers(F.col("_w._size"), F.col("_w.start"), F.col("_w.end"), max_chars, max_seconds))
    before = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum(F.array_max("_cue") + 1).over(before), F.lit(0)))
    rows = runs.select(key, "_base", F.inline(F.arrays_zip("_w", "_cue")))
    return rows.select(key, "_w.*", (F.col("_base") + F.col("_cue") + 1).alias("cue")).drop("_size")


def build_cues(words: DataFrame, key: str, order: str, width: int = 42, lines: int = 2, max_seconds: float = 7.0, min_seconds: float = 1.0, pause: float = 0.4, sure: float = 0.6) -> DataFrame:
    """key, cue (from 1), start, end, text, low_confidence. A cue lasts min_seconds at least, but ends by the next one's first word."""
    rows = cue_ids(words, key, order, width * lines, max_seconds, pause)
    each = F.struct(F.col(order).alias("o"), F.trim("word").alias("w"), "start", "end")
    cues = rows.groupBy(key, "cue").agg(F.array_sort(F.collect_list(each)).alias("_w"), F.bool_or(F.coalesce("probability", F.lit(1.0)) < sure).alias("low_confidence"))
    first, last = F.col("_w")[0]["start"], F.element_at("_w", -1)["end"]
    cues = cues.select(key, "cue", first.alias("start"), F.greatest(last, first + min_seconds).alias("end"), wrap_text(F.array_join(F.col("_w.w"), " "), width).alias("text"), "low_confidence")
    after = F.lead("start").over(Window.partitionBy(key).orderBy("cue"))
    return cues.withColumn("end", F.when(after.isNull(), F.col("end")).otherwise(F.greatest(F.least("end", after), F.col("start") + 0.05)))


def cues_within(rows: DataFrame, keys: list[str], words: str, width: int = 42, lines: int = 2, max_seconds: float = 7.0, min_seconds: float = 1.0, pause: float = 0.4, sure: float = 0.6) -> DataFrame:
    """keys, cues: an array of the cues that build_cues makes, of an array of words (word, start, end, probability) in order.

    Nothing is shuffled, and what is held is the words of one row. The fold of a run keeps one entry a cue."""
    w = F.col("_w")
    own = lambda x: F.struct(F.trim(x["word"]).alias("word"), x["start"].alias("start"), x["end"].alias("end"), F.length(x["word"]).alias("size"), F.coalesce(x["probability"] < sure, F.lit(False)).alias("doubtful"))
    found = rows.select(*keys, F.transform(words, own).alias("_w"))
    at = lambda i: F.get("_w", i)
    cut = lambda i: (i == 0) | F.coalesce(at(i - 1)["word"].rlike(r"[.!?]$") | (at(i)["start"] - at(i - 1)["end"] >= pause), F.lit(False))
    places = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1)).otherwise(F.array().cast("array<int>"))
    found = found.withColumn("_runs", F.filter(places, cut))
    zero = F.struct(F.lit(0).alias("chars"), F.lit(None).cast("double").alias("began"), F.array().cast("array<int>").alias("firsts"))

    def step(a, i):
        fresh = lambda x: (F.size(a["firsts"]) == 0) | (a["chars"] + 1 + x["size"] > width * lines) | F.coalesce(x["end"] - a["began"] > max_seconds, F.lit(False))
        begun = lambda x: F.struct(x["size"].alias("chars"), x["start"].alias("began"), F.concat(a["firsts"], F.array(i)).alias("firsts"))
        longer = lambda x: F.struct((a["chars"] + 1 + x["size"]).alias("chars"), a["began"].alias("began"), a["firsts"].alias("firsts"))
        return let(at(i), lambda x: F.when(fresh(x), begun(x)).otherwise(longer(x)))

    after = lambda k, c: F.coalesce(F.get(c, k + 1), F.size("_w"))
    folded = F.transform("_runs", lambda p, k: F.aggregate(F.sequence(p, after(k, "_runs") - 1), zero, step)["firsts"])
    found = found.withColumn("_firsts", F.flatten(folded))

    def cue(f, k):
        stop = after(k, "_firsts")
        first, last, next_one = at(f)["start"], at(stop - 1)["end"], at(stop)["start"]
        least = F.greatest(last, first + min_seconds)
        end = F.when(next_one.isNull(), least).otherwise(F.greatest(F.least(least, next_one), first + 0.05))
        text = lambda x: wrap_text(F.array_join(F.transform(x, lambda y: y["word"]), " "), width)
        return let(F.slice("_w", f + 1, stop - f), lambda x: F.struct((k + 1).alias("cue"), first.alias("start"), end.alias("end"), text(x).alias("text"), F.exists(x, lambda y: y["doubtful"]).alias("low_confidence")))

    return found.select(*keys, F.transform("_firsts", cue).alias("cues"))


def flagged_cues(cues: DataFrame, key: str) -> DataFrame:
    """Cues of low confidence per clip."""
    return cues.groupBy(key).agg(F.count("*").alias("n_cues"), F.count_if("low_confidence").alias("n_flagged"))


def karaoke_events(words: DataFrame, key: str, order: str, vertical: bool = True, emoji: str = "") -> DataFrame:
    """One event a word: its group in capitals with that word active. Times are relative to clip_start, 0 at least."""
    size = 3 if vertical else 5
    w = Window.partitionBy(key).orderBy(order)
    at = lambda c: F.greatest(F.lit(0.0), F.col(c) - F.col("clip_start"))
    rows = words.withColumns({"_n": F.row_number().over(w) - 1, "start": at("start"), "end": at("end"), "_w": F.upper(F.trim("word"))}).withColumn("group", F.floor(F.col("_n") / size))
    own = Window.partitionBy(key, "group").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # at most `size` rows
    rows = rows.withColumns({"_all": F.collect_list("_w").over(own), "_at": F.col("_n") % size})
    styled = F.transform("_all", lambda x, i: F.concat(F.when(i == F.col("_at"), F.lit("{\\rActive}")).otherwise(F.lit("{\\rInactive}")), x))
    line = F.concat(F.lit(f"{{\\rActive}}{emoji}\\N" if emoji else ""), F.array_join(styled, " "))
    return rows.select(key, "group", F.col("_n").alias("event"), "start", "end", line.alias("line"))


def even_events(text, start, end, clip_start, vertical: bool = True, emoji: str = "") -> Column:
    """The events of karaoke_events for a clip whose words have even times, as an array (group, event, start, end, line) within its row; null without words."""
    size = 3 if vertical else 5
    line_of = lambda group, place: F.array_join(F.transform(group, lambda x, i: F.concat(F.when(i == place, F.lit("{\\rActive}")).otherwise(F.lit("{\\rInactive}")), x)), " ")
    head = F.lit(f"{{\\rActive}}{emoji}\\N" if emoji else "")
    at = lambda c: F.greatest(F.lit(0.0), c - clip_start)
    group = lambda w, k: F.slice(w, (k - k % size) + 1, size)
    event = lambda w, x, k: F.struct(F.floor(k / size).alias("group"), k.alias("event"), at(x["start"]).alias("start"), at(x["end"]).alias("end"), F.concat(head, line_of(group(w, k), k % size)).alias("line"))
    timed = even_words(text, start, end, lambda x, k, a, b: F.struct(F.upper(F.trim(x)).alias("word"), a.alias("start"), b.alias("end")))
    return let(timed, lambda t: let(F.transform(t, lambda x: x["word"]), lambda w: F.transform(t, lambda x, k: event(w, x, k))))


#: The script, style and event sections that the subtitle format and its players ask for.
ASS_HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: {width}
PlayResY: {height}
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Active,Arial,{font},&HFFFFFF,&HFFFFFF,&H0000FF,&H0000FF,1,0,0,0,100,100,0,0,3,0,0,2,10,10,{margin},1
Style: Inactive,Arial,{font},&HCCCCCC,&HCCCCCC,&H80000000,&H80000000,1,0,0,0,100,100,0,0,3,0,0,2,10,10,{margin},1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def ass_header(vertical: bool = True) -> str:
    """Script and style sections, portrait or landscape."""
    width, height, font, margin = (1080, 1920, 85, 350) if vertical else (1920, 1080, 60, 90)
    return ASS_HEADER.format(width=width, height=height, font=font, margin=margin)


def _document(rows: DataFrame, key: str, order: str, line: Column, between: str) -> DataFrame:
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("_l"))
    return lists.select(key, F.array_join(F.col("_l.line"), between).alias("document"))


def dialogue(start, end, line) -> Column:
    """One event as a line of a subtitle document."""
    return F.concat(F.lit("Dialogue: 0,"), timecode(start, "ass"), F.lit(","), timecode(end, "ass"), F.lit(",Inactive,,0,0,0,,"), line)


def render_ass(events: DataFrame, key: str, vertical: bool = True) -> DataFrame:
    """One document a clip."""
    line = dialogue(F.col("start"), F.col("end"), F.col("line"))
    return _document(events, key, "event", line, "\n").withColumn("document", F.concat(F.lit(ass_header(vertical)), "document", F.lit("\n")))


def ass_of(events, vertical: bool = True) -> Column:
    """The document of a clip's events, an array in order."""
    return F.concat(F.lit(ass_header(vertical)), F.array_join(F.transform(events, lambda e: dialogue(e["start"], e["end"], e["line"])), "\n"), F.lit("\n"))


def srt_of(cues) -> Column:
    """The document of an array of cues in order; null without any."""
    line = lambda c: F.concat(c["cue"].cast("string"), F.lit("\n"), timecode(c["start"], "srt"), F.lit(" --> "), timecode(c["end"], "srt"), F.lit("\n"), c["text"])
    return F.when(F.size(cues) > 0, F.concat(F.array_join(F.transform(cues, line), "\n\n"), F.lit("\n")))


def render_srt(cues: DataFrame, key: str) -> DataFrame:
    """One document a clip; cues are numbered from 1."""
    line = F.concat(F.col("cue").cast("string"), F.lit("\n"), timecode(F.col("start"), "srt"), F.lit(" --> "), timecode(F.col("end"), "srt"), F.lit("\n"), "text")
    return _document(cues, key, "cue", line, "\n\n").withColumn("document", F.concat("document", F.lit("\n")))
