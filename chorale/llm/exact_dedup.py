"""Exact deduplication by composable polynomial fingerprints.

A text is hashed in chunks, h(c) = sum of (byte + 1) * B^(bytes after it in c) modulo a prime. Two neighbours combine by a
length-shifted sum, h(ab) = h(a) * B^|b| + h(b), so the chunks of a huge text are hashed independently of each other and of
their order. Texts with equal length and fingerprints are compared chunk by chunk: for each chunk number of a class the least
and the greatest chunk are kept, partially aggregated before the shuffle, and a class in which they differ is split by SHA-256.
No task holds a class, and the chunks of one text never meet in memory.

Defined results: null text is the empty text; a null doc_id sorts after all others; of rows with the same doc_id and equal
texts one stays. Columns other than doc_id and text are ignored by the operator and kept by `drop_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import documents, id_type, raw, runs, small, table, with_known

MODULI = (2**31 - 1, 2**31 - 19)
BASES = (911_382_323, 972_663_749)
CHUNK = 4096
#: Characters of a chunk in the comparison of texts.
COMPARED = 1 << 16


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space; single spaces aren't touched, which spares most of the work."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def power(base: int, exponent: np.ndarray, modulus: int) -> np.ndarray:
    """base ** exponent modulo modulus, elementwise."""
    out, square, e = np.ones(len(exponent), np.uint64), np.uint64(base % modulus), exponent.astype(np.uint64)
    m = np.uint64(modulus)
    while e.any():
        odd = (e & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * square % m
        square, e = square * square % m, e >> np.uint64(1)
    return out


def combine(left: int, right: int, right_length: int, which: int = 0, modulus: int | None = None) -> int:
    """The fingerprint of two neighbouring pieces."""
    m = modulus or MODULI[which]
    return (left * pow(BASES[which], right_length, m) + right) % m


def fingerprints(data: np.ndarray, ends: np.ndarray, modulus: int, base: int, chunk: int = CHUNK) -> np.ndarray:
    """Of all texts that data holds one after the other; ends has their bounds, 0 first."""
    lengths = np.diff(ends)
    count = np.maximum(1, -(-lengths // chunk))
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(lengths)), count)
    start = ends[text] + (np.arange(len(text)) - first[text]) * chunk
    end = np.minimum(start + chunk, ends[text + 1])
    m = np.uint64(modulus)
    powers = power(base, np.arange(chunk), modulus)
    hashes = np.zeros(len(text), np.uint64)
    for i in range(0, len(text), 256):  # a bounded piece of even the longest text at a time
        s, e = start[i : i + 256], end[i : i + 256]
        lo, hi = int(s[0]), int(e[-1])
        if hi == lo:
            continue
        behind = np.repeat(e, e - s) - 1 - np.arange(lo, hi)
        product = np.append((data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers[behind], np.uint64(0))
        hashes[i : i + 256] = np.where(e > s, np.add.reduceat(product, s - lo) % m, np.uint64(0))
    shifted = hashes * power(base, ends[text + 1] - end, modulus) % m
    return np.add.reduceat(shifted, first) % m if len(first) else hashes


def fingerprint_table(df: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """doc_id, row (tells rows apart once written), sha, n_bytes and fp of each row."""
    norm = normalised(F.col("text"))
    rows = df.select("doc_id", norm.cast("binary").alias("body")).select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2("body", 256).alias("sha"), "body")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, "body"):
                data, ends = raw(part.column(3))
                one, two = (fingerprints(data, ends, m, b) for m, b in zip(moduli, BASES, strict=True))
                fp = ((one << np.uint64(31)) | two).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(ends)), pa.array(fp)], names=["doc_id", "row", "sha", "n_bytes", "fp"])

    return rows.mapInArrow(hashed, f"doc_id {id_type(df)}, row long, sha string, n_bytes long, fp long")


def unequal(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Of classes (sha, fp, n_bytes, n), those fp and n_bytes under which different texts meet, by comparing chunks."""
    body = normalised(F.col("text"))
    texts = df.select(body.alias("body")).withColumn("sha", F.sha2(F.col("body").cast("binary"), 256))
    cut = F.expr(f"sequence(0, cast((greatest(char_length(body), 1) - 1) div {COMPARED} as int))")
    chunks = with_known(texts, classes, ["sha"], "n").where("fp is not null").select("fp", "n_bytes", "body", F.explode(cut).alias("k"))
    chunks = chunks.select("fp", "n_bytes", "k", F.expr(f"substring(body, k * {COMPARED} + 1, {COMPARED})").alias("piece"))
    ends = chunks.groupBy("fp", "n_bytes", "k").agg(F.min("piece").alias("least"), F.max("piece").alias("most"))
    return ends.where("least <> most").select("fp", "n_bytes").distinct()


def copies(df: DataFrame, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """A row for each row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    found = table(fingerprint_table(df, moduli))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "row")
    # a row for each different text, or each two texts that SHA-256 takes for one
    per = table(found.groupBy("fp", "n_bytes", "sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")))
    several = per.groupBy("fp", "n_bytes").agg(F.sum("n").alias("size")).where("size > 1").select("fp", "n_bytes")
    classes = table(per.join(several, ["fp", "n_bytes"], "left_semi").select("sha", "fp", "n_bytes", "n"))
    wrong = table(unequal(df, classes))
    n_wrong = wrong.count()
    found, per = found.withColumn("part", F.lit("")), per.withColumn("part", F.lit(""))
    if n_wrong:
        bad = small(wrong.withColumn("bad", F.lit(True)), n_wrong)
        split = lambda x: x.join(bad, ["fp", "n_bytes"], "left").withColumn("part", F.when(F.col("bad"), F.col("sha")).otherwise("")).drop("bad")
        found, per = split(found), split(per)
    key = ["fp", "n_bytes", "part"]
    groups = table(per.groupBy(*key).agg(F.min("first").alias("first"), F.sum("n").alias("size")).where("size > 1"))
    out = with_known(found, groups, key, "size")
    return out.select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("size").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(df: DataFrame) -> DataFrame:
    """df without the rows that `copies` drops, all columns kept."""
    told = table(copies(df).select("doc_id", "kept"))
    ids = told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("stay"))
    gone, again = ids.where("stay = 0").select("doc_id"), ids.where("n > 1 and stay > 0")
    gone, again = table(gone), table(again)
    lost, twice = gone.count(), again.count()
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id"))
    left = df.alias("d").join(small(gone, lost).alias("g"), same, "left_anti")
    if not twice:
        return left
    # rows that share a doc_id: texts tell which of them stay
    mark = small(again.select("doc_id"), twice).alias("g")
    single, shared = left.alias("d").join(mark, same, "left_anti"), left.alias("d").join(mark, same, "left_semi")
    kept = table(copies(df).where("kept")).select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    shared = shared.withColumn("_sha", F.sha2(normalised(F.col("text")).cast("binary"), 256)).dropDuplicates(["doc_id", "_sha"])
    shared = shared.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("_sha") == F.col("k_sha")), "left_semi").drop("_sha")
    return single.unionByName(shared)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir))


ORACLE = {
    "op9_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               row_number() over (partition by norm order by doc_id nulls last) = 1 as kept, sha256(norm) as text_sha256 from t"""
}
QUERIES = {"op9_exact_dedup": op9_exact_dedup}
