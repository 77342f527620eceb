"""Secret scan with multipart credential linking; DataFrame functions only.

Base spans are the matches of three patterns. Weak parts are long mixed tokens ("weak"), addresses
("endpoint": a URL or an IPv4 address) and accounts ("login": user@host); none of them is a secret by
itself. A credential has an identifier (access or login), a secret (assign or weak) and often an endpoint.
Parts are spread over buckets of SCOPE code points, and an interval join with the buckets around a weak part
tells which parts of other roles start within SCOPE of it. A weak token is reported beside an identifier or
an endpoint; a login beside a secret; an endpoint beside an assigned secret, or beside an access identifier
with a weak token. Parts that overlap don't complement each other. An address that carries user and password
itself ("dsn") holds all its parts, so it is reported alone. The join is keyed by the text's hash, so copies
are linked once; parts of a kind are disjoint, so a bucket holds few.

Matches are found in one pass; their places are running sums in blocks of the square root of their number.
Null and empty texts have no spans. Repeated rows and rows without an id each get a row; ties of start go by
kind, in the order of KINDS. An empty table gives an empty result. Only the id and text columns are read;
`redact` hands all columns through under whatever names.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, texts

# The patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WEAK = r"(?<![A-Za-z0-9+/_])(?=[A-Za-z+/_]*[0-9])(?=[0-9+/_]*[A-Za-z])[A-Za-z0-9+/_]{24,}"
ENDPOINT = r"""https?://[^\s"'<>]{4,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.]*[0-9])"""
# The repeated group is possessive: a greedy one recurses once a repetition.
LOGIN = r"""(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++"""
DSN = r"""[a-z][a-z0-9+.-]{1,31}://[^\s:/@"'<>]+:[^\s/@"'<>]+@[^\s"'<>]+"""
KINDS = ["assign", "access", "hex", "weak", "endpoint", "login", "dsn"]
SCOPE, BLOCK = 256, 4096
SPANS = "array<struct<start:long,rank:int,end:long>>"
BAR, OTHER = "\x01", "\x02"


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def _sums(parts: Column) -> Column:
    """Spans from the lengths (gap, hit) of matches: running sums within blocks, and over the blocks before."""
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<struct<at:long,block:array<struct<gap:int,hit:int,own:int>>>>")
    n = F.greatest(F.ceil(F.sqrt(F.size(parts))).cast("int"), F.lit(1))
    blocks = _let(n, lambda n: F.transform(F.sequence(F.lit(0), F.size(parts) - 1, n), lambda at: F.slice(parts, at + 1, n)))
    total = lambda block: F.aggregate(block, zero, lambda a, p: a + p["gap"] + p["hit"])
    based = F.aggregate(
        blocks, F.struct(zero.alias("at"), empty.alias("out")),
        lambda a, b: F.struct((a["at"] + total(b)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), b.alias("block")))).alias("out")),
        lambda a: a["out"],
    )
    span = F.array().cast("array<struct<start:long,end:long,own:int>>")
    walk = lambda b: F.aggregate(
        b["block"], F.struct(b["at"].alias("at"), span.alias("out")),
        lambda a, p: F.struct((a["at"] + p["gap"] + p["hit"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["hit"]).alias("end"), p["own"].alias("own")))).alias("out")),
        lambda a: a["out"],
    )
    return F.when(F.size(parts) > 0, F.flatten(F.transform(based, walk))).otherwise(span)


def _spans(rank: int, pattern: str, may: Column, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches whose group has at least so many characters. One pass sets bars around each match and its group."""
    barred = F.split(F.regexp_replace(F.translate("text", BAR, OTHER), F.lit(pattern), F.lit(f"{BAR}$0{BAR}${group}{BAR}")), BAR, -1)
    trio = lambda size, i: F.struct(F.get(size, i).alias("gap"), F.get(size, i + 1).alias("hit"), F.get(size, i + 2).alias("own"))
    starts = lambda size: F.when(F.size(size) > 3, F.sequence(F.lit(0), F.size(size) - 4, F.lit(3))).otherwise(F.array().cast("array<int>"))
    parts = _let(F.transform(barred, F.length), lambda size: F.transform(starts(size), lambda i: trio(size, i)))
    kept = F.filter(_let(parts, _sums), lambda s: s["own"] >= least)
    return F.when(may, F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))).otherwise(F.array().cast(SPANS))


def _render(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _linked(found: DataFrame) -> DataFrame:
    """key, added: the weak parts of each text that have their complements in scope."""
    parts = found.select("key", F.explode(F.concat("assign", "access", "weak", "endpoint", "login")).alias("s")).select("key", "s", F.floor(F.col("s.start") / SCOPE).alias("bucket"))
    near = parts.select("key", F.col("s.rank").alias("part"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"))
    weak = parts.where(F.col("s.rank") >= 3)
    # An address and the weak part in its own path are one thing, not two that meet.
    apart = (F.col("end") <= F.col("s.start")) | (F.col("s.end") <= F.col("start"))
    join = weak.join(near, ["key", "bucket"]).where((F.abs(F.col("s.start") - F.col("start")) <= SCOPE) & apart)
    has = lambda *kinds: F.bool_or(F.col("part").isin(*[KINDS.index(k) for k in kinds]))
    met = join.groupBy("key", "s").agg(has("access").alias("access"), has("login").alias("login"), has("assign").alias("assign"), has("weak").alias("weak"), has("endpoint").alias("endpoint"))
    rule = (
        F.when(F.col("s.rank") == KINDS.index("weak"), F.expr("access or login or endpoint"))
        .when(F.col("s.rank") == KINDS.index("login"), F.expr("assign or weak"))
        .otherwise(F.expr("assign or (access and weak)"))
    )
    return met.where(rule).groupBy("key").agg(F.collect_list("s").alias("added"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (the text's hash), assign, access, hex, base and spans (arrays of start, rank in KINDS, end)."""
    text = F.col("text")
    words = F.lower(text)
    assign = words.contains("passw") | words.contains("secret") | words.contains("token") | words.contains("api_key") | words.contains("apikey")
    partner = text.contains("AKIA") | text.contains("://") | text.contains("@")
    rows = texts(docs, id_col, text_col).select(
        "doc_id", F.sha2("text", 256).alias("key"),
        _spans(0, ASSIGN, assign, 2, 12).alias("assign"), _spans(1, ACCESS, text.contains("AKIA")).alias("access"), _spans(2, HEX, text.rlike("[0-9a-f]{16}")).alias("hex"),
        _spans(3, WEAK, (partner | text.rlike(r"[0-9]\.[0-9]+\.[0-9]")) & text.rlike("[A-Za-z0-9+/_]{24}")).alias("weak"),
        _spans(4, ENDPOINT, text.contains("://") | text.rlike(r"[0-9]\.[0-9]+\.[0-9]")).alias("endpoint"),
        _spans(5, LOGIN, text.contains("@")).alias("login"), _spans(6, DSN, text.contains("://") & text.contains("@")).alias("dsn"),
    )
    overlap = lambda w, *kinds: F.exists(F.concat(*kinds), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    apart = lambda kind, *kinds: F.filter(kind, lambda w: ~overlap(w, *kinds))
    some = F.size("weak") + F.size("endpoint") + F.size("login") > 0
    rows = durable(rows.withColumns({k: F.when(some, apart(k, "assign", "access", "hex", "dsn")).otherwise(F.col(k)) for k in ("weak", "endpoint", "login")}))
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    may = some & (F.size("assign") + F.size("access") + F.size("endpoint") + F.size("login") > 0)
    linked = _linked(rows.where(may).dropDuplicates(["key"]))
    spans = lambda added: F.array_sort(F.concat("base", "dsn", added))
    none = F.array().cast(SPANS)
    met = rows.where(may).join(linked, "key", "left").withColumn("spans", spans(F.coalesce("added", none)))
    out = ["doc_id", "key", "assign", "access", "hex", "base", "spans"]
    return met.select(out).union(rows.where(~may).withColumn("spans", spans(none)).select(out))


def _without(found: DataFrame) -> DataFrame:
    """key, gaps: the places of each text that no span covers, in order; the last one has no end. One running maximum a text."""
    spans = found.select("key", F.inline(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    so_far = F.max("end").over(Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("at", F.coalesce(so_far, F.lit(0).cast("long")))
    gap = F.when(F.col("start") >= F.col("at"), F.struct(F.col("at").alias("start"), F.col("start").alias("end")))
    last = F.struct(F.max("end").alias("start"), F.lit(None).cast("long").alias("end"))
    return rows.withColumn("gap", gap).groupBy("key").agg(F.concat(F.array_sort(F.collect_list("gap")), F.array(last)).alias("gaps"))


def _cut(text: Column, gaps: Column, mark: str) -> Column:
    """The text of the gaps, with mark between them. It is cut from blocks, as finding a place in a text takes all that stands before."""
    n = F.length(text)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), lambda i: text.substr(i * BLOCK + 1, F.lit(BLOCK)))

    def piece(blocks, g):
        start, end = g["start"].cast("int"), F.coalesce(g["end"].cast("int"), n)
        first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        part = lambda i: F.get(blocks, i).substr(F.greatest(start - i * BLOCK, F.lit(0)) + 1, F.least(end - i * BLOCK, F.lit(BLOCK)) - F.greatest(start - i * BLOCK, F.lit(0)))
        return F.array_join(F.transform(F.sequence(first, last), part), "")

    return _let(blocks, lambda blocks: F.array_join(F.transform(gaps, lambda g: piece(blocks, g)), mark))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """docs with every span of text_col replaced by mark, other columns as they are; overlapping spans are one."""
    own = uuid.uuid4().hex  # no column of docs has such names
    key, gaps, text = f"key_{own}", f"gaps_{own}", F.col(text_col)
    found = find_secrets(docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")))
    found = _without(found.where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))).select(F.col("key").alias(key), F.col("gaps").alias(gaps))
    rows = docs.join(found, F.sha2(F.coalesce(text, F.lit("")), 256) == F.col(key), "left")
    return rows.select(*[F.when(F.col(gaps).isNull(), text).otherwise(_cut(text, F.col(gaps), mark)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_render(F.col("base")), 256).alias("base_sha256"), _render(F.col("spans")).alias("spans"))
