"""Numeric, array and decision functions over columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def let(c, use) -> Column:
    """use(c), where c is worked out once, however often use names it (also within its lambdas)."""
    return F.get(F.transform(F.array(c), use), 0)


def running_sum(c, block: int = 512) -> Column:
    """Sums of an array of doubles up to each place, by blocks, so that a long array isn't copied at each step."""
    none = F.array().cast("array<double>")
    sums = lambda x: F.aggregate(x, none, lambda a, v: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + v)))
    parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda i: sums(F.slice(x, i * block + 1, block)))
    before = lambda ends, i: F.coalesce(F.get(ends, i - 1), F.lit(0.0))
    moved = lambda p, ends: F.flatten(F.transform(p, lambda own, i: let(before(ends, i), lambda base: F.transform(own, lambda v: base + v))))
    joined = lambda p: let(sums(F.transform(p, lambda own: F.get(own, F.size(own) - 1))), lambda ends: moved(p, ends))
    return let(c, lambda x: F.when(F.size(x) > 0, let(parts(x), joined)).when(F.size(x) == 0, none))


def mean_vector(vectors) -> Column:
    """Mean of each component of an array of vectors; nulls don't count, and a component without any is null."""
    zero = F.array().cast("array<struct<s:double,n:bigint>>")
    add = lambda a, x: F.struct((F.coalesce(a["s"], F.lit(0.0)) + F.coalesce(x.cast("double"), F.lit(0.0))).alias("s"), (F.coalesce(a["n"], F.lit(0).cast("long")) + x.isNotNull().cast("long")).alias("n"))
    sums = F.aggregate(vectors, zero, lambda a, v: F.when(v.isNull(), a).otherwise(F.zip_with(a, v, add)))
    return F.transform(sums, lambda x: F.try_divide(x["s"], x["n"]))


def softmax(c) -> Column:
    shares = lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda x: x / total))
    return let(c, lambda own: let(F.array_max(own), lambda top: let(F.transform(own, lambda x: F.exp(x - top)), shares)))


def argmax(c) -> Column:
    """0-based place of the largest value, the first of equals; null for an empty array."""
    return F.nullif(F.array_position(c, F.array_max(c)), F.lit(0)) - 1


def l2_normalize(c) -> Column:
    """Vector of length 1; a zero vector stays."""
    return let(c, lambda own: let(F.sqrt(dot(own, own)), lambda size: F.transform(own, lambda v: F.coalesce(F.try_divide(v.cast("double"), size), F.lit(0.0)))))


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-c))


def clip01(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def engagement_rates(views="views", likes="likes", comments="comments") -> dict[str, Column]:
    v, n, m = F.col(views), F.col(likes), F.col(comments)
    return {"like_rate": n / v, "comment_rate": m / v, "engagement_rate": (n + m) / v, "log_views": F.log1p(v)}


def bed_duration(given, seconds, low: float = 2.0, high: float = 15.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(F.nullif(given, F.lit(0.0)), seconds)))


def bed_tokens(seconds, per_second: float = 50.0) -> Column:
    return F.floor(seconds * per_second).cast("int")


def denoise_strength(snr, flatness, force=False) -> Column:
    s = F.when(snr >= 20, 0).when(snr >= 10, 1).otherwise(2)
    f = F.when(flatness < 0.3, 0).when(flatness < 0.6, 1).otherwise(2)
    score = F.when((s >= 1) & (f >= 1), F.least(F.greatest(s, f) + 1, F.lit(2))).otherwise(F.greatest(s, f))
    return F.when(F.lit(force), "strong").otherwise(F.element_at(F.array(*map(F.lit, ["none", "mild", "strong"])), score + 1))


def denoise_decision(snr, flatness, clipping, force=False) -> Column:
    """should_denoise, strength, reason (what each measure says, and a note on clipped samples), snr_at_decision."""
    strength = denoise_strength(snr, flatness, force)
    by_snr = F.when(snr >= 20, F.format_string("clean SNR of %.1f dB", snr)).when(snr >= 10, F.format_string("moderate noise at %.1f dB", snr)).otherwise(F.format_string("heavy noise at %.1f dB", snr))
    by_flat = F.when(flatness < 0.3, F.format_string("tonal spectrum of flatness %.3f", flatness)).when(flatness < 0.6, F.format_string("borderline spectrum of flatness %.3f", flatness)).otherwise(F.format_string("noise-like spectrum of flatness %.3f", flatness))
    note = F.when(clipping > 0.005, F.format_string("; CLIPPING of %.3f%% of samples", clipping * 100)).otherwise("")
    reason = F.when(F.lit(force), F.concat(F.lit("forced: "), by_snr)).otherwise(F.concat(by_snr, F.lit("; "), by_flat, note))
    return F.struct((strength != "none").alias("should_denoise"), strength.alias("strength"), reason.alias("reason"), snr.alias("snr_at_decision"))


def gain_plan(level, peak, target: float = -23.0, max_peak: float = 0.99) -> Column:
    """applied, limited (by the peak), gain, gain_db; not applied and 0 dB where the level isn't finite."""
    fine = level.isNotNull() & ~F.isnan(level) & (F.abs(level) != float("inf"))
    g = gain(level, peak, target, max_peak)
    limited = fine & (peak * F.pow(F.lit(10.0), (F.lit(target) - level) / 20) > max_peak)
    return F.struct(fine.alias("applied"), limited.alias("limited"), g.alias("gain"), F.when(fine, 20 * F.log10(g)).otherwise(0.0).alias("gain_db"))


def gain(level, peak, target: float = -23.0, max_peak: float = 0.99) -> Column:
    """Linear gain to the target level that keeps the peak; 1 (0 dB) where the level isn't finite."""
    want = F.pow(F.lit(10.0), (F.lit(target) - level) / 20)
    fine = level.isNotNull() & ~F.isnan(level) & (F.abs(level) != float("inf"))
    return F.when(~fine, 1.0).when(peak * want > max_peak, max_peak / peak).otherwise(want)


# Valence and arousal of each emotion.
EMOTIONS = {"anger": (-0.6, 0.8), "disgust": (-0.6, 0.4), "fear": (-0.7, 0.8), "joy": (0.8, 0.6), "neutral": (0.0, 0.0), "sadness": (-0.7, -0.4), "surprise": (0.4, 0.7)}


def music_mood(v, a) -> Column:
    return F.when((F.abs(v) < 0.15) & (F.abs(a) < 0.2), "calm").when((v >= 0) & (a >= 0), "bright").when(v >= 0, "peaceful").when(a >= 0, "dark").otherwise("melancholic")


# The words of a music prompt, by mood, key and tempo, and those that every prompt has.
MOODS = {"calm": "calm, neutral, understated", "bright": "bright, uplifting, hopeful", "peaceful": "warm, gentle, peaceful", "dark": "dark, tense, suspenseful, dissonant", "melancholic": "somber, melancholic, hollow"}
MODES = {"major": "major key", "minor": "minor key", "modal": "modal"}
TEMPOS = {"fast": "energetic and driving, around 120 BPM", "slow": "slow and sparse, around 60 BPM, ambient", "middle": "moderate tempo, around 90 BPM"}
PROMPT = "{} instrumental background music, {}, {}, cinematic underscore, no vocals"


def music_prompt(v, a) -> Column:
    """Mood, key and tempo in words."""
    mood = F.element_at(F.create_map(*[F.lit(x) for kv in MOODS.items() for x in kv]), music_mood(v, a))
    mode = F.when(v >= 0.15, MODES["major"]).when(v <= -0.15, MODES["minor"]).otherwise(MODES["modal"])
    tempo = F.when(a >= 0.5, TEMPOS["fast"]).when(a <= -0.1, TEMPOS["slow"]).otherwise(TEMPOS["middle"])
    return F.format_string(PROMPT.replace("{}", "%s"), mood, mode, tempo)
