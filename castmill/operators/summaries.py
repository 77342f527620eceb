"""Chunks of whole sentences, and extractive summaries by TF-IDF centroids.

Chunks, terms, centroids and ranks are worked out within the row of a key that holds its sentences in order, so nothing is
shuffled for them. Sentences that come as rows are brought together once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from . import centroids

BUDGET = 1024


def gathered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, sentences: an array of the other columns of its rows, in order."""
    item = F.struct(F.col(order).alias("_o"), F.struct(*[c for c in rows.columns if c != key]).alias("r"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("sentences"))
    return lists.select(key, F.transform("sentences", lambda x: x["r"]).alias("sentences"))


def chunk_firsts(sizes: Column, budget: int = BUDGET, split: bool = True) -> Column:
    """For the token counts of sentences in order an array of (at, chunk): the place of each chunk's first sentence, and the chunk's number.

    Sentences go to the current chunk while it holds at most budget tokens; one over the budget is a chunk by itself,
    and with split takes as many chunk numbers as it has pieces of the budget. The fold keeps one entry a chunk."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("chunk"), F.lit(budget + 1).alias("held"), F.array().cast("array<struct<at:int,chunk:int>>").alias("firsts"))

    def step(a, n):
        over = n > budget
        fresh = over | (a["held"] + n > budget)
        taken = F.when(over & F.lit(split), F.ceil(n / budget).cast("int")).otherwise(1)
        held = F.when(over, budget).when(fresh, n).otherwise(a["held"] + n)
        firsts = F.when(fresh, F.concat(a["firsts"], F.array(F.struct(a["i"].alias("at"), (a["chunk"] + 1).alias("chunk"))))).otherwise(a["firsts"])
        return F.struct((a["i"] + 1).alias("i"), F.when(fresh, a["chunk"] + taken).otherwise(a["chunk"]).alias("chunk"), held.alias("held"), firsts.alias("firsts"))

    return F.aggregate(sizes, zero, step)["firsts"]


def gather_chunks(rows: DataFrame, key: str, order: str, budget: int = BUDGET, text: str = "text", split: bool = True) -> DataFrame:
    """key, chunks: an array of (chunk, rows) in order, rows with their n_tokens."""
    lists = gathered(rows.withColumn("n_tokens", F.size(words(text))), key, order).withColumnRenamed("sentences", "_s")
    found = lists.withColumn("_f", chunk_firsts(F.transform("_s", lambda x: x["n_tokens"]), budget, split))
    last = lambda i: F.coalesce(F.get("_f", i + 1)["at"], F.size("_s"))
    return found.select(key, F.transform("_f", lambda f, i: F.struct(f["chunk"].alias("chunk"), F.slice("_s", f["at"] + 1, last(i) - f["at"]).alias("rows"))).alias("chunks"))


def _rows_of(chunks: DataFrame, key: str) -> DataFrame:
    """The rows of all chunks, with their chunk. No key is without rows; the outer form keeps a test for that, with all that makes the array, out of the filters."""
    columns = [f.name for f in chunks.schema["chunks"].dataType.elementType["rows"].dataType.elementType]
    each = F.transform("chunks", lambda c: F.transform(c["rows"], lambda r: F.struct(c["chunk"].alias("chunk"), *[r[x].alias(x) for x in columns])))
    return chunks.select(key, F.flatten(each).alias("_rows")).select(key, F.inline_outer("_rows"))


def pack_chunks(rows: DataFrame, key: str, order: str, budget: int = BUDGET, text: str = "text", split: bool = True) -> DataFrame:
    """rows with chunk, n_tokens and piece; with split a sentence over the budget is cut into rows of at most budget tokens, a chunk each (piece numbers them)."""
    own = _rows_of(gather_chunks(rows, key, order, budget, text, split), key)
    if not split:
        return own.withColumn("piece", F.lit(0))
    pieces = F.when(F.col("n_tokens") > budget, F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / budget).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    own = own.withColumn("piece", F.explode(pieces))
    cut = F.when(F.col("n_tokens") > budget, F.array_join(F.slice(words(text), F.col("piece") * budget + 1, budget), " ")).otherwise(F.col(text))
    return own.withColumns({text: cut, "chunk": F.col("chunk") + F.col("piece"), "n_tokens": F.when(F.col("n_tokens") > budget, F.least(F.lit(budget), F.col("n_tokens") - F.col("piece") * budget)).otherwise(F.col("n_tokens"))})


def _again(order: str) -> Column:
    """For sentences in order, whether each has the order of the one before."""
    return F.transform("sentences", lambda x, i: F.coalesce(x[order] == F.get("sentences", i - 1)[order], F.lit(False)))


def _titled(docs: DataFrame, key: str, titles: DataFrame | None) -> DataFrame:
    """docs with _title, its key's titles in one text, or null."""
    if titles is None:
        return docs.withColumn("_title", F.lit(None).cast("string"))
    return docs.join(titles.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.collect_list("title"), " ").alias("_title")), key, "left")


def centroid_scores(rows: DataFrame, key: str, order: str, text: str = "text", titles: DataFrame | None = None, part: str | None = None) -> DataFrame:
    """key (and part), order, score: cosine of each sentence's TF-IDF vector to the sum of all of its key's (and part's).

    A title (key, title) joins the sum. idf counts sentences. Terms are lower-case words and numbers; a sentence without any
    has no score."""
    ids = [key, *([part] if part else [])]
    some = rows.select(F.struct(*ids).alias("_id"), F.col(order).alias("_o"), F.col(text).alias("_text"))
    docs = _titled(gathered(some, "_id", "_o").select("_id.*", "sentences"), key, titles)
    orders = F.array_distinct(F.transform("sentences", lambda x: x["_o"]))
    scores = centroids.scores()(F.transform("sentences", lambda x: F.lower(x["_text"])), _again("_o"), F.array(F.lit(0)), F.lower("_title"))
    each = docs.select(*ids, F.inline(F.arrays_zip(orders.alias(order), scores.alias("score"))))
    return each.where("score is not null")


def summarize_within(docs: DataFrame, key: str, order: str, budget: int = BUDGET, per_chunk: int = 2, most: int = 3, titles: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """docs (one row a key, its sentences an array of (order, text) in order) with summary and chosen: the best sentences of each
    chunk, and of these the best of all, at most `most`, in their own order. Rows without a term or a key go, or with keep stay.

    A key's sentences are scored within its row, by an Arrow function; nothing is shuffled but for titles."""
    text, n = F.transform("sentences", lambda x: F.lower(x["text"])), F.transform("sentences", lambda x: F.size(words(F.coalesce(x["text"], F.lit("")))))
    ready = _titled(docs if keep else docs.where(F.col(key).isNotNull()), key, titles)
    firsts = F.transform(chunk_firsts(n, budget, False), lambda f: f["at"])
    found = ready.withColumn("_k", centroids.chosen(per_chunk, most)(text, _again(order), firsts, F.lower("_title")))
    found = found.withColumn("_s", F.transform("_k", lambda i: F.get("sentences", i)))
    best = F.struct(F.array_join("_s.text", " ").alias("summary"), F.transform("_s", lambda x: x[order]).alias("chosen"))
    # The outer form keeps the test for chosen sentences, and with it a second run of the function, out of the filters.
    found = found.select(*docs.columns, F.inline_outer(F.when(F.size("_k") > 0, F.array(best))))
    return found if keep else found.where("chosen is not null")


def summarize_extractive(rows: DataFrame, key: str, order: str, budget: int = BUDGET, per_chunk: int = 2, most: int = 3, titles: DataFrame | None = None) -> DataFrame:
    """key, summary, chosen: as summarize_within, of sentences that come as rows."""
    return summarize_within(gathered(rows.select(key, order, "text"), key, order), key, order, budget, per_chunk, most, titles).select(key, "summary", "chosen")
