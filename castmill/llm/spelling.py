"""Spelling variants grouped by asymmetric q-chunks: words one edit apart, and of each the far more frequent form.

A word of M code points gives two disjoint chunks, its first and its last M // 2 code points; one edit leaves at least one
of them whole. The other word gives positional grams of that length, for each M that one edit can reach. A chunk meets the
equal grams that stand within one place of it, and pairs that meet are verified by edit distance. What an edit behind the
first chunk leaves whole stands at the start, and what one before the last chunk does at the end, moved by the difference
of the lengths, one at most; so of all positional grams only those at these places are made. Where a chunk's words times its grams' words are over CROWD, the chunk alone says too little:
there the rest of both words must meet too, as the rest with one code point taken out (for a replaced one, at the same
place); so pairs grow with the near pairs, not with the square of a crowd. Words over LONG code points meet by chunks alone
and are verified in linear time.

Words are counted before anything is shuffled whole; only distinct words meet. A word's form is its near word of the largest
count (ties: the smallest in code-point order) if that is at least RATIO times its own; counts grow along forms, so a chain
has at most 18 steps, and doubling finds its root in five joins.

Null and empty texts have no words; a missing id counts as an empty one in the hash that decides about the taken-out code
point; repeated rows each count. An empty table gives an empty result. Other columns aren't read.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import ascii_lower, durable, table, texts
from .copies import small

LEAST, TWICE, RATIO, CROWD, LONG = 7, 2, 10, 4096, 256
RUN = r"[A-Za-zÀ-ÿ]{7,}"  # shorter runs can't give words of LEAST


def without(word: Column, at: Column) -> Column:
    """word less its code point at a place from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def spoiled_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters; where 31 divides the crc32 of id and run, less one code point."""
    runs = texts(docs, id_col, text_col).select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    word = F.when(F.col("h") % 31 == 0, without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TWICE)


def _keyed(m: Column, c: int, at: Column) -> Column:
    """The key of the gram of m // 2 code points at a place, as chunk c of words of m code points."""
    gram = F.substr("word", at + 1, F.floor(m / 2).cast("int"))
    return F.struct(F.xxhash64(m, F.lit(c), gram).alias("key"), m.alias("m"), F.lit(c).alias("c"))


def chunk_rows(words: DataFrame) -> DataFrame:
    """key, m, c, word, n: both chunks of each word."""
    m = F.length("word")
    return words.select(F.inline(F.array(_keyed(m, 0, F.lit(0)), _keyed(m, 1, m - F.floor(m / 2).cast("int")))), "word", "n")


def gram_rows(words: DataFrame) -> DataFrame:
    """key, m, c, word, n: for words of m code points, one more or less than its own or as many, the grams that their chunks can be."""
    size, found = F.length("word"), []
    for more in (-1, 0, 1):
        m = size + more
        found += [_keyed(m, 0, F.lit(0)), _keyed(m, 1, size - F.floor(m / 2).cast("int"))]
    return words.select(F.inline(F.array(*found)), "word", "n")


def _rests(rows: DataFrame, gram: bool) -> DataFrame:
    """rows with rest: hashes of the word beside the chunk, as one edit to or from a word of m code points can leave it.

    A replaced code point is taken out on both sides, at one place; one too many on the longer side alone."""
    q = F.floor(F.col("m") / 2).cast("int")
    rows = rows.withColumn("beside", F.when(F.col("c") == 0, F.substr("word", q + 1)).otherwise(F.substr("word", F.lit(1), F.length("word") - q)))
    each = lambda kind, placed: F.transform(F.sequence(F.lit(0), F.length("beside") - 1), lambda j: F.xxhash64(F.lit(kind), j if placed else F.lit(-1), without(F.col("beside"), j)))
    whole = lambda kind: F.array(F.xxhash64(F.lit(kind), F.lit(-1), "beside"))
    if gram:
        more = F.length("word") - F.col("m")
        rests = F.when(more == 0, each("same", True)).when(more > 0, each("shorter", False)).otherwise(whole("longer"))
    else:
        rests = F.concat(each("same", True), whole("shorter"), each("longer", False))
    return rows.withColumn("rest", F.explode(F.array_distinct(rests))).drop("beside")


@F.pandas_udf(BooleanType())
def one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two different words are one code point inserted, deleted or replaced apart, in linear time."""

    def one(x: str, y: str) -> bool:
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if len(y) - len(x) > 1:
            return False
        u, v = (np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in (x, y[: len(x)]))
        differ = np.flatnonzero(u != v)
        k = int(differ[0]) if len(differ) else len(x)
        return y[k + 1 :] == (x[k + 1 :] if len(x) == len(y) else x[k:])

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=bool)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each word with each word that differs from it by one code point inserted, deleted or replaced."""
    chunks, grams = chunk_rows(words), gram_rows(words)
    sizes = chunks.select("key", F.lit(1).alias("x"), F.lit(0).alias("y")).union(grams.select("key", F.lit(0), F.lit(1))).groupBy("key").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    crowded = small(sizes.where(F.col("x") * F.col("y") > CROWD).select("key"))
    long = F.length("word") > LONG
    other = lambda rows: rows.select("key", *[F.col("rest")] * ("rest" in rows.columns), F.col("word").alias("near"), F.col("n").alias("near_n"))
    mine = lambda rows: rows.select("key", *[F.col("rest")] * ("rest" in rows.columns), "word", "n")
    apart = F.col("word") != F.col("near")
    calm = mine(chunks.where(~long).join(crowded, "key", "left_anti")).join(other(grams), "key")
    dense = mine(_rests(chunks.where(~long).join(crowded, "key", "left_semi"), False)).join(other(_rests(grams.where(F.length("word") <= LONG + 1).join(crowded, "key", "left_semi"), True)), ["key", "rest"])
    met = [p.select("word", "n", "near", "near_n").where(apart & (F.levenshtein("word", "near", 1) == 1)) for p in (calm, dense)]
    far = mine(chunks.where(long)).join(other(grams.where(F.length("word") >= LONG)), "key").select("word", "n", "near", "near_n").where(apart).where(one_edit("word", "near"))
    return met[0].union(met[1]).union(far).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: the last of the chain of forms, by doubling."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(5):
        step = now.join(small(now.select(F.col("word").alias("root"), F.col("root").alias("next"))), "root", "left")
        step = durable(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return now


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of counted words (word, n)."""
    words = durable(words.select("word", "n"))
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("form"))).alias("b"))
    own = words.join(best, "word", "left")
    form = -F.col("b.k") >= ratio * F.col("n")
    own = durable(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("b.form")).alias("form"), F.when(form, -F.col("b.k")).alias("form_n")))
    ends = roots(own.where("form is not null"))
    return own.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spoiled_words(table(spark, sf_dir, "documents")))


ORACLE_SQL = r"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 7 GROUP BY 1, 2),
b AS (SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS bytes FROM d),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
g AS (SELECT word, n, j, left(word, j) || substr(word, j + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS j FROM w)),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.j = b.j AND a.cut = b.cut AND length(a.word) = length(b.word) AND a.word <> b.word UNION SELECT g.word, g.n, w.word, w.n FROM g JOIN w ON g.cut = w.word UNION SELECT w.word, w.n, g.word, g.n FROM g JOIN w ON g.cut = w.word),
o AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS b FROM p GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * w.n THEN -b[1] END AS form_n FROM w LEFT JOIN o USING (word)),
c AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
l AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN l USING (word)"""
