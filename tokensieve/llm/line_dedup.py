"""Removal of multi-line chunks that repeat anywhere in the corpus.

A text's lines are hashed; a rolling hash over the last two line hashes
closes a chunk wherever it divides by ``mean_lines``. Boundaries depend on
nearby lines alone, so equal passages are cut alike wherever they stand.
Chunks of two lines or more are counted by hash; those whose hash repeats are
compared by their bytes, and every occurrence but the first, by
(doc_id, place), is removed. A passage of a few lines may hold no whole chunk
and then stays; ``dedup_passages`` finds those too, by all pairs of lines.

Built-in expressions and joins only. Chunk texts are shuffled for repeated hashes
alone, and a chunk of very many copies is combined before the
shuffle.

Defined results: a null text stays null and has no chunks, an empty one stays empty; rows
that agree in ``doc_id`` and ``text`` are one document and all keep the first
occurrence; rows that share a ``doc_id`` only are told apart by their text; an
empty table gives no rows. All input columns are returned; working columns
carry a prefix of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

P = "_ts_line_"


def _line_hash(line: Column) -> Column:
    """The first 48 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("long")


def with_chunks(docs: DataFrame, mean_lines: int = 4) -> DataFrame:
    """Adds the array of (place, lines, text) of each text's chunks."""
    lines, marks, starts = F.col(P + "lines"), F.col(P + "marks"), F.col(P + "starts")
    n = F.size(lines)
    df = docs.withColumn(P + "lines", F.split("text", "\n", -1))
    df = df.withColumn(P + "marks", F.transform(lines, _line_hash))
    rolling = lambda i: F.get(marks, i) + 31 * F.coalesce(F.get(marks, i - 1), F.lit(0))
    inner = F.when(n > 1, F.filter(F.sequence(F.lit(1), n - 1), lambda i: rolling(i - 1) % mean_lines == 0)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(P + "starts", F.concat(F.array(F.lit(0)), inner))

    def chunk(start, k):
        size = F.coalesce(F.get(starts, k + 1), n) - start
        return F.struct(k.alias("k"), size.alias("n"), F.array_join(F.slice(lines, start + 1, size), "\n").alias("t"))

    df = df.withColumn(P + "chunks", F.when(F.col("text").isNotNull(), F.transform(starts, chunk)))
    return df.drop(P + "lines", P + "marks", P + "starts")


def _at(chunks: str, places: str) -> Column:
    """The chunks at ``places``."""
    return F.transform(places, lambda k: F.get(chunks, k))


def dedup_lines(docs: DataFrame, mean_lines: int = 4) -> DataFrame:
    """``docs`` with ``text`` cleaned, and the columns ``removed_lines`` and
    ``removed_chunks``, prefixed where the input already has them."""
    source = docs.withColumn(P + "h", F.xxhash64("text"))
    row = [F.col("doc_id").alias(P + "doc"), F.col(P + "h").alias(P + "own")]
    same = F.col("doc_id").eqNullSafe(F.col(P + "doc")) & (F.col(P + "h") == F.col(P + "own"))

    # explode_outer: a filter inferred from explode would compute the chunks a second time, inlined
    slim = source.select("doc_id", P + "h", "text")
    exploded = with_chunks(slim, mean_lines).select(*row, F.explode_outer(P + "chunks").alias("c")).where("c.n > 1")
    marks = written(exploded.select(P + "doc", P + "own", "c.k", F.xxhash64("c.t").alias("key")), "marks")
    often = written(marks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key")), "often")
    suspect = marks.join(often, F.col("key") == F.col("_key")).groupBy(P + "doc", P + "own").agg(F.collect_set("k").alias("ks"))

    texts = slim.join(suspect, same).drop(P + "doc", P + "own")
    # chunks are taken by place, as array_contains would read the array once for each chunk
    texts = with_chunks(texts, mean_lines).select(*row, F.explode_outer(_at(P + "chunks", "ks")).alias("c"))
    texts = written(texts.select(P + "doc", P + "own", "c.k", F.xxhash64("c.t").alias("key"), "c.t"), "texts")
    place = F.struct(P + "doc", P + "own", "k")
    first = texts.groupBy("key", "t").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = written(first.select(F.col("key").alias("_key"), F.col("t").alias("_t"), "_first"), "first")
    # the byte comparison: the key finds, the text decides
    again = texts.join(first, (F.col("key") == F.col("_key")) & (F.col("t") == F.col("_t"))).where(~place.eqNullSafe(F.col("_first")))
    gone = again.groupBy(P + "doc", P + "own").agg(F.collect_set("k").alias(P + "gone"))

    chunks = with_chunks(source.join(gone, same, "left").drop(P + "doc", P + "own"), mean_lines)
    dropped = _at(P + "chunks", P + "gone")
    left = F.array_except(F.sequence(F.lit(0), F.size(P + "chunks") - 1), P + "gone")
    kept = F.array_join(F.transform(left, lambda k: F.get(P + "chunks", k)["t"]), "\n")
    clean = F.when(F.col(P + "gone").isNull(), F.col("text")).otherwise(kept)
    name = lambda c: P + c if c in docs.columns else c
    return chunks.select(
        *(clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col(P + "gone").isNull(), 0).otherwise(F.aggregate(dropped, F.lit(0), lambda a, c: a + c.n)).cast("long").alias(name("removed_lines")),
        F.coalesce(F.size(P + "gone"), F.lit(0)).cast("long").alias(name("removed_chunks")),
    )


def _pairs(lines: Column, places: Column) -> Column:
    """(place, text) of each two adjacent lines at ``places`` (of the first)."""
    return F.transform(places, lambda i: F.struct(i.alias("k"), F.concat(F.get(lines, i), F.lit("\n"), F.get(lines, i + 1)).alias("t")))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of repeated passages of two lines or more,
    and the column ``removed_lines``, prefixed where the input already has it.

    The anchors are all pairs of adjacent lines, overlapping, so a shared
    passage is found from its second line on and to its last, wherever it
    stands. Of each pair that repeats, byte for byte, the first occurrence by
    (doc_id, place) stays whole; the lines of the others go, except those that
    are also in a first occurrence. A single line that repeats between
    different lines stays. Nulls, empty texts and repeated rows are as in
    ``dedup_lines``.
    """
    source = docs.withColumn(P + "h", F.xxhash64("text"))
    row = [F.col("doc_id").alias(P + "doc"), F.col(P + "h").alias(P + "own")]
    same = F.col("doc_id").eqNullSafe(F.col(P + "doc")) & (F.col(P + "h") == F.col(P + "own"))
    lines = F.split("text", "\n", -1)

    # rows that agree in id and text are one document, so a pair's places count once
    slim = source.where(F.contains("text", F.lit("\n"))).select("doc_id", P + "h", "text")
    firsts = F.sequence(F.lit(0), F.size(P + "lines") - 2)
    split = slim.withColumn(P + "lines", lines)
    marks = split.select(*row, F.explode_outer(F.transform(_pairs(F.col(P + "lines"), firsts), lambda c: F.struct(c.k.alias("k"), F.xxhash64(c.t).alias("key")))).alias("c"))
    marks = written(marks.select(P + "doc", P + "own", "c.k", "c.key"), "marks")
    often = written(marks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key")), "often")
    suspect = marks.join(often, F.col("key") == F.col("_key")).groupBy(P + "doc", P + "own").agg(F.collect_set("k").alias("ks"))

    texts = slim.join(suspect, same).drop(P + "doc", P + "own").withColumn(P + "lines", lines)
    texts = texts.select(*row, F.explode_outer(_pairs(F.col(P + "lines"), F.col("ks"))).alias("c")).select(P + "doc", P + "own", "c.k", "c.t")
    texts = written(texts.select(P + "doc", P + "own", "k", F.xxhash64("t").alias("key"), "t"), "texts")
    place = F.struct(P + "doc", P + "own", "k")
    first = texts.groupBy("key", "t").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first != _last")
    first = written(first.select(F.col("key").alias("_key"), F.col("t").alias("_t"), "_first"), "first")
    # the byte comparison: the key finds, the text decides
    found = texts.join(first, (F.col("key") == F.col("_key")) & (F.col("t") == F.col("_t"))).select(P + "doc", P + "own", "k", (place == F.col("_first")).alias("stays"))
    places = lambda stays: F.collect_set(F.when(F.col("stays") == stays, F.col("k")))
    gone = found.groupBy(P + "doc", P + "own").agg(places(False).alias("later"), places(True).alias("firsts"))
    both = lambda c: F.array_union(c, F.transform(c, lambda i: i + 1))
    gone = gone.select(P + "doc", P + "own", F.array_except(both(F.col("later")), both(F.col("firsts"))).alias(P + "gone")).where(F.size(P + "gone") > 0)

    marked = source.join(gone, same, "left").withColumn(P + "lines", F.when(F.col(P + "gone").isNotNull(), lines))
    # set operations and places, as array_contains would read the array once for each line
    left = F.array_except(F.sequence(F.lit(0), F.size(P + "lines") - 1), P + "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get(P + "lines", i)), "\n")
    clean = F.when(F.col(P + "gone").isNull(), F.col("text")).otherwise(kept)
    name = P + "removed_lines" if "removed_lines" in docs.columns else "removed_lines"
    return marked.select(*(clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
                         F.coalesce(F.size(P + "gone"), F.lit(0)).cast("long").alias(name))


#: DuckDB's form of the query.
SQL = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
h as (select *, cast('0x' || substr(md5(line), 1, 12) as bigint) as v from l),
b as (select *, (v + 31 * coalesce(lag(v) over (partition by doc_id order by i), 0)) % 4 = 0 as ends from h),
c as (select *, coalesce(sum(case when ends then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as k from b),
g as (select doc_id, k, count(*) as n, string_agg(line, chr(10) order by i) as t from c group by doc_id, k),
f as (select *, row_number() over (partition by t order by doc_id, k) as r from g),
m as (select *, n > 1 and r > 1 as gone from f)
select doc_id, coalesce(string_agg(case when not gone then t end, chr(10) order by k), '') as text,
  cast(sum(case when gone then n else 0 end) as bigint) as removed_lines, cast(sum(case when gone then 1 else 0 end) as bigint) as removed_chunks
from m group by doc_id
"""
