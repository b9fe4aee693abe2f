"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is 13 consecutive words of a benchmark item, or a shorter item as a whole. It occurs in a document only if the document
has every word of it, so with the words ordered by how rare they are in the documents, a prefix of one word, the rarest, is
enough. Documents' words join on that word; the length bound asks for a document of as many words as the window, the positional
bound for room before and behind the word; what is left is compared word for word at its place. Only hits leave the scan stage:
the words of a document are never written or shuffled.

The windows of a benchmark are broadcast in blocks of a counted size, one pass over the documents for each block; blocks are
dealt by hash, so there is a way for a benchmark of any size. The first pass counts each document's words as well, by a mark
behind the last one. Covered words are counted from starts and ends in order, per text. Windows with the same items share a set
of items, and texts with the same sets share their union, so a window that all items have costs a document one number.

`drop_contaminated` has its own rule, as a long document may hold a passage that is a small part of it: a document goes if it
holds any window of full size, or if windows of shorter items cover a twentieth of its words.

Defined results: null and empty text have no words, no hits and the SHA-256 of the empty string; null or empty items have no
windows; items with the same item_id count once; rows with the same doc_id and text get the same result each; extra columns are
ignored by `contamination` and kept by `drop_contaminated`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import BROADCAST_BYTES, documents, lower_az, small, table, total_bytes, with_known

SIZE = 13
#: Windows of a benchmark in one broadcast, which also keeps to the bytes of one.
BLOCK = 200_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands behind a document's last word; no word is like it.
MARK = " "


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(text), GAP), "")


def text_hash(text: Column) -> Column:
    """Tells texts of one doc_id apart; null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id and the words of each window."""
    said = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(0, greatest(size(w) - {size}, 0))")
    return said.select("item_id", F.explode(starts).alias("s"), "w").select("item_id", F.slice("w", F.col("s") + 1, size).alias("window")).distinct()


def by_rarity(wins: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct windows with their rarest word (prefix) and its offset; counts are of all documents' words."""
    sought = table(wins.select(F.explode("window").alias("word")).distinct())
    n = sought.count()
    every = docs.select(F.explode_outer(words(F.col("text"))).alias("word"))
    counts = table(every.join(small(sought, n), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    each = wins.select("window").distinct().select("window", F.posexplode("window").alias("offset", "word"))
    # a word that no document has makes its window impossible: the inner joins would keep it by its other words
    rare = each.join(small(counts, n), "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("r"))
    return rare.where("r.n > 0").select("window", F.col("r.word").alias("prefix"), F.col("r.offset").alias("offset"))


def occurrences(docs: DataFrame, indexed: DataFrame, n: int) -> DataFrame:
    """doc_id, h (of the text), start, len and sid of each place in documents where a window of indexed occurs.

    Each document also has a row with sid -1, and the number of its words as start.
    """
    blocks = max(1, -(-n // BLOCK), -(-total_bytes(indexed, n) // BROADCAST_BYTES))
    doc = docs.select("doc_id", text_hash(F.col("text")).alias("h"), words(F.coalesce("text", F.lit(""))).alias("w"))
    mark = indexed.sparkSession.range(1).select(F.array().cast("array<string>").alias("window"), F.lit(MARK).alias("prefix"), F.lit(0).alias("offset"), F.lit(-1).cast("long").alias("sid"))
    size = F.size("window")
    fits = (F.size("w") >= size) & (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + size <= F.size("w"))
    same = F.slice("w", F.greatest(F.col("pos") - F.col("offset") + 1, F.lit(1)), size) == F.col("window")
    found = []
    for b in range(blocks):
        block = indexed if blocks == 1 else indexed.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
        said = F.array_append("w", MARK) if b == 0 else F.col("w")
        place = doc.select("doc_id", "h", "w", F.posexplode(said).alias("pos", "word"))
        block = block.select("window", "prefix", "offset", "sid")
        hit = place.join(F.broadcast(block.unionByName(mark) if b == 0 else block), (F.col("word") == F.col("prefix")) & fits & same)
        found.append(hit.select("doc_id", "h", (F.col("pos") - F.col("offset")).alias("start"), size.alias("len"), "sid"))
    return reduce(DataFrame.unionByName, found)


def item_sets(wins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """window, sid and sid, items: windows that the same items have share a number."""
    of = table(wins.groupBy("window").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    sets = table(of.select("items").distinct().withColumn("sid", F.monotonically_increasing_id()))  # numbers are given once, by writing them
    return of.join(sets, "items").select("window", "sid"), sets


def items_of(hits: DataFrame, sets: DataFrame) -> DataFrame:
    """doc_id, h, n_items and items_sha256 of each text with hits."""
    had = table(hits.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("sid")).alias("sids")))
    unions = had.groupBy("sids").agg(F.count(F.lit(1)).alias("n"))
    items = F.sort_array(F.collect_set("item"))
    named = unions.select("sids", "n", F.explode("sids").alias("sid")).join(small(sets, sets.count()), "sid").select("sids", "n", F.explode("items").alias("item"))
    named = named.groupBy("sids", "n").agg(items.alias("items"))
    named = table(named.select("sids", "n", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")))
    return with_known(had, named, ["sids"], "n").select("doc_id", "h", "n_items", "items_sha256")


def by_text(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """contamination with h (of the text) and whole: whether a window of full size occurs."""
    wins = table(windows(benchmark, size))
    numbered, sets = item_sets(wins)
    indexed = table(by_rarity(wins, docs).join(numbered, "window"))
    found = table(occurrences(docs, indexed, indexed.count()))
    hits = table(found.where("sid >= 0").distinct())
    # how many words no earlier hit of the text has covered
    reach = Window.partitionBy("doc_id", "h").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    until = F.coalesce(F.max(F.col("start") + F.col("len")).over(reach), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", until))
    covered = hits.select("doc_id", "h", "start", "len").distinct().withColumn("fresh", fresh)
    covered = covered.groupBy("doc_id", "h").agg(F.sum("fresh").cast("long").alias("n_hit"), F.max("len").alias("longest"))
    named = items_of(hits, sets).select(F.col("doc_id").alias("i_id"), F.col("h").alias("i_h"), "n_items", "items_sha256")
    told = covered.join(named, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("h") == F.col("i_h")))
    told = table(told.select(F.col("doc_id").alias("id"), F.col("h").alias("hh"), "n_hit", "longest", "n_items", "items_sha256"))
    out = found.where("sid < 0").select("doc_id", "h", F.col("start").cast("long").alias("n_words"))
    out = out.join(small(told, told.count()), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hh")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "h",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.col("longest") >= size, F.lit(False)).alias("whole"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return by_text(docs, benchmark, size).drop("h", "whole")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """docs without those that hold a window of full size or are `contaminated` by shorter items; all columns kept.

    Of rows that share a doc_id or have none, those with such a text go.
    """
    gone = table(by_text(docs, benchmark, size).where("whole or contaminated").select("doc_id", "h").distinct())
    mark = small(gone, gone.count()).alias("g")
    return docs.alias("d").join(mark, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (text_hash(F.col("d.text")) == F.col("g.h")), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = {
    "op6_decontaminate": r"""
        with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
        b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
        bw as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') as g
               from (select item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) as s from b where len(w) > 0)),
        sizes as (select distinct n from bw),
        dw as (select doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') as g
               from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as s from d, sizes where len(w) >= n)),
        hit as (select doc_id, s, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
        pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
        it as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join pos using (doc_id) left join it using (doc_id)"""
}
QUERIES = {"op6_decontaminate": op6_decontaminate}
