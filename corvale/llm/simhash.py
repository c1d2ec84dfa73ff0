"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two
bits differ in at most two bytes, so they share at least six of eight: that is the
guaranteed minimum. The index has postings keyed by four of the eight bytes, for the
six choices of two of the four byte pairs; whichever two bytes differ, some choice
avoids both, so each link meets in a posting list. (Lists of one byte would each hold
1/256 of all rows.) A pair comes out of each list in which it meets with the positions of
that list; the tally joins them, completes the positions that no list showed, and counts.
Pairs under six are dropped, and the rest are verified on the bits. Only distinct
fingerprints enter the index; copies hang on by membership.

A list with more than ``LIST_CAP`` distinct fingerprints is keyed anew by six bytes, with
each choice of two of the other four: a link shares six, so it meets in one of those lists,
and they go into the same tally. A list of six bytes holds at most 65,536 fingerprints; one
with more than ``FINE_CAP`` is not paired: each member names itself and its one-bit
neighbours in the two bytes outside the key, and is linked to the smallest fingerprint that
names the same point. Two members name a common point exactly if they differ in at most two
bits, so that way is exact too, and linear.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any
other. Texts are taken whole. Repeated doc_ids keep their rows. A null doc_id gets the
component of its fingerprint. Tables without rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.llm.common import binary_column, cut, each_batch, table, written
from corvale.llm.components import components

SEED = 42
#: Members of a list of four, and of six bytes, up to which it is paired.
LIST_CAP = 64
FINE_CAP = 512
MAX_BITS = 2
MIN_BYTES = 6


def fingerprint(text: bytes, width: int = 3) -> int:
    """The unsigned fingerprint of one whole text in UTF-8."""
    words = text.lower().split()  # for bytes: A-Z only, ASCII blanks only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(s, SEED) for s in shingles], dtype="<u8")
    if len(hashes) > 256:  # count each byte value first: fewer bits to add up
        planes = hashes.view(np.uint8).reshape(-1, 8)
        counts = np.concatenate([np.bincount(planes[:, i], minlength=256) @ _BITS for i in range(8)])
    else:
        counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, width: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp, keys): fp as a signed long with the fingerprint's bits; keys are text columns that are passed on."""

    def work(rows: pa.Table) -> pa.Table:
        found = np.array([fingerprint(t, width) for t in binary_column(rows, "text")], dtype=np.uint64)
        return pa.table({"doc_id": rows["doc_id"], "fp": pa.array(found.view(np.int64)), **{k: rows[k] for k in keys}})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *keys)
    return each_batch(rows, work, ", ".join(["doc_id long", "fp long", *(f"{k} string" for k in keys)]))


def _byte(column, position: int):
    return F.shiftrightunsigned(column, 8 * position).bitwiseAND(F.lit(0xFF))


def _equal_positions(x, y):
    """Bit i is set if two fingerprints share positional byte i."""
    return sum(F.when(_byte(x.bitwiseXOR(y), i) == 0, 1 << i).otherwise(0) for i in range(8))


#: Positions (as bits) of the six kinds of lists of four bytes, and for each kind those of its lists of six.
COARSE = [(3 << 2 * i) | (3 << 2 * j) for i, j in combinations(range(4), 2)]
FINE = {kept: [kept | 1 << i | 1 << j for i, j in combinations([p for p in range(8) if not kept >> p & 1], 2)] for kept in COARSE}


def _bits(kept: int) -> int:
    """The signed 64-bit mask of the bytes at the positions."""
    mask = sum(0xFF << 8 * p for p in range(8) if kept >> p & 1)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _keyed(rows: DataFrame, kinds: list[int]) -> DataFrame:
    """(fp, kept, key): a posting for each kind of list."""
    return rows.select("fp", F.inline(F.array(*[F.struct(F.lit(k).alias("kept"), F.col("fp").bitwiseAND(F.lit(_bits(k))).alias("key")) for k in kinds])))


def _with_sizes(postings: DataFrame) -> DataFrame:
    """The postings of lists with two members at least, with their number."""
    sizes = written(postings.groupBy("kept", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "lists")
    return written(postings.join(sizes, ["kept", "key"]), "postings")


def _pairs(postings: DataFrame) -> DataFrame:
    """(a, b, kept): all pairs of each list."""
    x, y = postings.alias("x"), postings.alias("y")
    met = (F.col("x.kept") == F.col("y.kept")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
    return x.join(y, met).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), "x.kept")


def tally(pairs: DataFrame) -> DataFrame:
    """(a, b, shared): the positional bytes that each pair shares; those of its lists are known, the others are looked up."""
    seen = pairs.groupBy("a", "b").agg(F.bit_or("kept").alias("kept"))
    return seen.select("a", "b", F.bit_count(F.col("kept").bitwiseOR(_equal_positions(F.col("a"), F.col("b")))).alias("shared"))


def _stars(postings: DataFrame) -> DataFrame:
    """(a, b): links that join all members of a list within two bits, by the points that they name."""
    bits = F.sequence(F.lit(0), F.lit(63))
    free = F.filter(bits, lambda i: F.col("kept").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.floor(i / 8).cast("int"))) == 0)
    flips = F.transform(free, lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    points = postings.select("kept", "key", "fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    lowest = written(points.groupBy("kept", "key", "point").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("named")).where("named > 1"), "points")
    return points.join(lowest, ["kept", "key", "point"]).where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))


def links(distinct: DataFrame, list_cap: int = LIST_CAP, fine_cap: int = FINE_CAP) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that connect all pairs within two bits.

    From paired lists all linked pairs; from those beyond fine_cap links that span the same components."""
    coarse = _with_sizes(_keyed(distinct, COARSE))
    crowded = coarse.where(F.col("members") > list_cap)
    pairs = _pairs(coarse.where(F.col("members") <= list_cap))
    again = [_keyed(crowded.where(F.col("kept") == kept).select("fp"), kinds) for kept, kinds in FINE.items()] if not crowded.isEmpty() else []
    stars = None
    if again:
        fine = _with_sizes(reduce(DataFrame.unionByName, again).distinct())
        pairs = pairs.unionByName(_pairs(fine.where(F.col("members") <= fine_cap)))
        stars = _stars(fine.where(F.col("members") > fine_cap))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    found = tally(pairs).where(F.col("shared") >= MIN_BYTES).where(near).select("a", "b")
    return found if stars is None else found.unionByName(stars).distinct()


def _rooted(rows: DataFrame, list_cap: int, fine_cap: int) -> DataFrame:
    """(fp, first_id, root) of the distinct fingerprints of rows (doc_id, fp)."""
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, list_cap, fine_cap)).withColumnRenamed("node", "fp")
    return cut(distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, width: int = 3, list_cap: int = LIST_CAP, fine_cap: int = FINE_CAP) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links)."""
    rows = cut(fingerprints(docs, width))
    rooted = _rooted(rows, list_cap, fine_cap)
    smallest = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    named = written(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Exactly one row of each group stays, that with the smallest doc_id; null doc_ids lose to any other.

    A row is known by doc_id and text; of rows alike in both the smallest by further columns stays."""
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256)
    keyed = docs.select("doc_id", "text", key.alias("key"), F.struct(*docs.columns).alias("row"))
    rows = cut(fingerprints(keyed, keys=["key"]))
    rooted = _rooted(rows, LIST_CAP, FINE_CAP).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    stay = rows.join(rooted, "fp").groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias("key"))
    kept = keyed.select("key", "row").join(stay, "key", "left_semi")
    return kept.groupBy("key").agg(F.min("row").alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
