"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions alone.

Pass 1 is a counting filter of one hash: every normalised text's hash falls into one of ``SLOTS_PER_ROW`` slots a row, and
tasks send the counts of their slots, combined, never rows or texts (two numbers for a slot; a filter that tells
repeated hashes with a fixed error must hear about every hash, so this part grows with the rows). The slots that
more than one hash fell into make a Bloom filter of *possibly repeated* hashes: bitmaps of 32768 bits, two bits to a
slot, ``BITS_PER_SLOT`` bits for each slot that was hit twice and at most ``MAX_BITS`` (128 MB) in all, so it may be
broadcast. Pass 2 probes it with every row: rows that miss are certainly unique and pass straight through; only the others
shuffle, by their SHA-256.

Beyond about ``MAX_BITS`` / 10 different repeated texts (10**8) the filter fills up and lets ever more unique rows through to
the shuffle; results stay exact.

Defined results: a null text equals an empty one; a null id ranks after every other id; rows that repeat an
id with an equal text are copies of each other, of which one stays; an empty table gives an empty result;
other columns are carried along untouched, and those named like an added column are replaced by it. A very long text
is normalised and hashed where it is read; only its hash travels, except in ``drop_copies``, where one row of each task does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import carried, checkpointed, scope

#: Runs of white space that differ from one space; a lone space needs no rewriting.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Slots of the first pass for each row, and their most; bits of the filter for each repeated slot, and their most.
SLOTS_PER_ROW, MAX_SLOTS, BITS_PER_SLOT, MAX_BITS = 64, 1 << 44, 24, 1 << 30
#: Bits of a bitmap as the built-in aggregate makes it.
BITMAP = 32768
#: Groups of copies with more than one in so many of all rows are joined by broadcast.
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _power(n: int, most: int) -> int:
    """The least power of two from n on, and at most ``most``."""
    return min(most, 1 << max(0, (n - 1).bit_length()))


def _slot(sha: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(slots))


def _places(slot: Column, bitmaps: int) -> tuple[Column, list[Column]]:
    """A slot's bitmap and its two bits there."""
    h = F.xxhash64(slot, F.lit(1))
    return F.pmod(h, F.lit(bitmaps)), [F.pmod(F.shiftrightunsigned(h, n), F.lit(BITMAP)) for n in (30, 47)]


@dataclass
class Filter:
    """Bitmaps of the possibly repeated slots, as rows (bitmap, bits), and the sizes that place a hash in them."""

    rows: DataFrame
    bitmaps: int
    slots: int


def repeated_filter(hashes: DataFrame, sha: str, slots_per_row: int = SLOTS_PER_ROW, max_bits: int = MAX_BITS, max_slots: int = MAX_SLOTS) -> Filter:
    """Pass 1: the filter of the hashes that may be repeated; at most max_bits bits."""
    slots = _power(hashes.count() * slots_per_row, max_slots)
    twice = checkpointed(hashes.groupBy(_slot(F.col(sha), slots).alias("slot")).count().filter("count > 1").select("slot"), lasting=True)
    bitmaps = max(1, _power(twice.count() * BITS_PER_SLOT, max_bits) // BITMAP)
    bitmap, bits = _places(F.col("slot"), bitmaps)
    placed = twice.select(bitmap.alias("bitmap"), F.explode(F.array(*bits)).alias("bit"))
    return Filter(placed.groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits")), bitmaps, slots)


def probe(df: DataFrame, sha: str, bloom: Filter) -> DataFrame:
    """Pass 2: adds ``maybe_copy``; false means that no other row has this hash."""
    bitmap, bits = _places(_slot(F.col(sha), bloom.slots), bloom.bitmaps)
    side = bloom.rows.select(F.col("bitmap").alias("__bitmap"), F.col("bits").alias("__bits"))
    byte = lambda bit: F.conv(F.hex(F.substring("__bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = [F.call_function("shiftright", byte(bit), F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1 for bit in bits]
    hit = F.coalesce(is_set[0] & is_set[1], F.lit(False))
    return df.join(F.broadcast(side), bitmap == F.col("__bitmap"), "left").withColumn("maybe_copy", hit).drop("__bitmap", "__bits")


def copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = SLOTS_PER_ROW, max_bits: int = MAX_BITS, max_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The texts are read and hashed once; the narrow table of hashes is checkpointed and both passes use it.
    """
    narrow = checkpointed(df.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")).withColumn("__row", F.monotonically_increasing_id()))
    probed = probe(narrow, "text_sha256", repeated_filter(narrow, "text_sha256", slots_per_row, max_bits, max_slots))
    alone = probed.filter(~F.col("maybe_copy")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = probed.filter("maybe_copy")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    groups = checkpointed(maybe.groupBy("text_sha256").agg(first, F.count(F.lit(1)).alias("group_size")))
    # a group of at least a HOT_SHARE-th of the rows is hot: there are at most HOT_SHARE of them, which are broadcast
    hot = groups.filter(F.col("group_size") >= max(2, narrow.count() // HOT_SHARE + 1))
    found = [maybe.join(F.broadcast(hot), "text_sha256"), maybe.join(F.broadcast(hot), "text_sha256", "left_anti").join(groups, "text_sha256")]
    held = found[0].unionByName(found[1]).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("__row") == F.col("first.__row")).alias("kept"), "text_sha256")
    return alone.unionByName(held)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots_per_row: int = SLOTS_PER_ROW, max_bits: int = MAX_BITS, max_slots: int = MAX_SLOTS) -> DataFrame:
    """The rows that stay, with the input's columns: of equal texts the one with the smallest id.

    Copies meet in a grouping that keeps one row of each group on the map side already, so that a group of any
    size sends one row from each task.
    """
    columns = carried(df, ())
    with scope(df.sparkSession):
        hashes = checkpointed(df.select(F.sha2(normalised(F.col(text_col)), 256).alias("sha")))
        bloom = repeated_filter(hashes, "sha", slots_per_row, max_bits, max_slots)
    probed = probe(df.select(F.struct(*columns).alias("row"), F.sha2(normalised(F.col(text_col)), 256).alias("sha")), "sha", bloom)
    key = F.col(f"row.`{id_col}`")
    orderable = [F.col(f"row.`{c}`") for c, kind in df.dtypes if c != text_col and not kind.startswith(("map", "array", "struct", "variant"))]
    order = F.struct(key.isNull().alias("none"), key.alias("id"), F.xxhash64(*orderable).alias("rest") if orderable else F.lit(0).alias("rest"))
    first = probed.filter("maybe_copy").groupBy("sha").agg(F.min_by("row", order).alias("row"))
    return probed.filter(~F.col("maybe_copy")).select("row.*").unionByName(first.select("row.*"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return copy_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
