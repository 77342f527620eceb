"""Text functions over columns; all stay in generated code or Spark's own expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import let

EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"
# The characters that count as emoji of a caption; a wider class than the flag of titles.
CAPTION_EMOJI = r"[\x{10000}-\x{10FFFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}]"


def squash_ws(c) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(words(c))


def title_flags(c) -> dict[str, Column]:
    """Flags and sizes of a title, by column name."""
    c = F.col(c) if isinstance(c, str) else c
    return {
        "title_char_len": F.length(c), "title_word_count": word_count(c), "has_emoji": c.rlike(EMOJI), "has_hashtag": c.contains("#"),
        "has_number": c.rlike(r"(?U)\d"), "has_question": c.contains("?"), "has_exclaim": c.contains("!"), "upper_ratio": upper_ratio(c),
    }


def upper_ratio(c) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{IsUppercase}]+", "")) / F.greatest(F.length(c), F.lit(1))


def sentences(c) -> Column:
    return F.filter(F.split(F.trim(c), r"(?U)(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def lines(c, min_words: int = 4) -> Column:
    """Stripped non-blank lines, or sentences where there is at most one line; lines under min_words go."""
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    found = F.filter(F.transform(F.split(c, r"\R"), strip), lambda s: s != "")
    either = let(found, lambda own: F.when(F.size(own) <= 1, sentences(strip(c))).otherwise(own))
    return F.filter(either, lambda s: F.size(words(s)) >= min_words)


def est_seconds(n_words) -> Column:
    return F.greatest(F.lit(1.0), F.bround(n_words / 2.5).cast("double"))


def safe_clip_name(c, most: int = 30) -> Column:
    name = F.translate(F.trim(F.regexp_replace(F.substring(c, 1, most), r"[^\p{IsAlphabetic}\p{IsDigit} _-]", "")), " ", "_")
    return F.when(name == "", "clip").otherwise(name)


def normalize_markers(c) -> Column:
    return F.trim(F.replace(c, F.lit("<n>"), F.lit(" ")))


def asr_normalize(c) -> Column:
    return squash_ws(F.regexp_replace(F.lower(c), r"\p{P}", ""))


def ends_sentence(c) -> Column:
    return F.rtrim(c).rlike(r"[.?!]$")


def starts_upper(c) -> Column:
    return F.ltrim(c).rlike(r"^\p{IsUppercase}")


def timecode(seconds, kind: str) -> Column:
    """ass h:mm:ss.cc, srt hh:mm:ss,mmm or preview mm:ss.ss; rounded before it is split."""
    unit = 1000 if kind == "srt" else 100
    n = F.round(F.greatest(seconds, F.lit(0.0)) * unit).cast("long")
    part = lambda n, a, m: F.pmod(F.floor(n / a), F.lit(m))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    wide = lambda c: F.when(c < 10, two(c)).otherwise(c.cast("string"))
    if kind == "srt":
        code = lambda n: F.concat(wide(F.floor(n / 3_600_000)), F.lit(":"), two(part(n, 60_000, 60)), F.lit(":"), two(part(n, 1000, 60)), F.lit(","), F.lpad(F.pmod(n, F.lit(1000)).cast("string"), 3, "0"))
    elif kind == "ass":
        code = lambda n: F.concat(F.floor(n / 360_000).cast("string"), F.lit(":"), two(part(n, 6000, 60)), F.lit(":"), two(part(n, 100, 60)), F.lit("."), two(F.pmod(n, F.lit(100))))
    else:
        code = lambda n: F.concat(wide(F.floor(n / 6000)), F.lit(":"), two(part(n, 100, 60)), F.lit("."), two(F.pmod(n, F.lit(100))))
    return let(n, code)


def wrap_text(c, width: int = 42) -> Column:
    """Greedy wrap; a longer word has a line of its own."""
    step = lambda a, w: F.when(a == "", w).when(F.length(F.substring_index(a, "\n", -1)) + 1 + F.length(w) <= width, F.concat(a, F.lit(" "), w)).otherwise(F.concat(a, F.lit("\n"), w))
    return F.aggregate(words(c), F.lit(""), step)


def extract_emoji(c, default: str) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.regexp_extract_all(c, F.lit(f"({CAPTION_EMOJI})"), F.lit(1)), ""), F.lit("")), F.lit(default))


def truncate_tokens(c, most: int = 64) -> Column:
    """The first words, as many as a scorer takes."""
    return F.array_join(F.slice(words(c), 1, most), " ")


def join_text(order: str, text: str) -> Column:
    """Aggregate: texts in order, blank ones left out, with a blank between."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.filter(F.transform(rows, lambda x: F.trim(x["t"])), lambda t: t != ""), " ")
