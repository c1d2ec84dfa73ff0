"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens. Whole sequences are emitted at
once. Of the rest each partition packs its own pieces best-fit, longest first, and emits
the bins that are nearly full. Underfull bins then climb a tree as rows of (bin, fill): the
bins of ``FAN_IN`` nodes meet in one, where they count as items of a further best-fit
round, until one node is left. Their pieces stay where they are and learn at the end where
their bin went.

A node's memory is bounded without any loss. After a best-fit round a node has at most one
bin that is half full or less, and two fuller ones never fit together; so no more bins of
any one fill can find a partner than there are bins of at most half left in the whole
level, and the others of that fill are closed. Bins that not even the least filled one left
fits into are closed too.

Edge cases: a null or empty text is one piece with the end token alone. A text of exactly
a multiple of the capacity has whole pieces only. A text with a very long run of blanks is
encoded by merge rounds, since the compiled splitter does not take it. Repeated rows and
rows with null doc_ids are packed each. Tables without rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.llm.bpe import byte_letters, default_tokenizer, vocabulary
from corvale.llm.common import binary_column, table, written

CAPACITY = 2048
END = 0
FAN_IN = 8
#: Pieces that a partition packs at a time.
LOCAL_ROWS = 1_000_000
#: Characters of a run of blanks beyond which the compiled splitter may run out of stack.
LONG_BLANKS = 1 << 16
_LONG_RUN = re.compile(r"(?<!\s)\s{%d}" % LONG_BLANKS)
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
PACKED = f"{PIECE}, bin long, offset long, node long, done boolean"
MOVED = "old long, bin long, shift long, fill long, node long, done boolean"


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """An encoder with the ids of the vocabulary at path: the same ranks in a compiled library."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = byte_letters()
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), set(added)


def ids_of(text: str, path: str) -> np.ndarray:
    """The ids of one whole text, with the end token."""
    if len(text) >= LONG_BLANKS and _LONG_RUN.search(text):
        ids = vocabulary(path).encode_batch([text])[0]
    else:
        encoder, special = fast_encoder(path)
        ids = encoder.encode_to_numpy(text, allowed_special=special)
    return np.append(np.asarray(ids, dtype="<u4"), np.array([END], dtype="<u4"))


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = tokens % capacity or min(tokens, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, tokens, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, max_bytes: int = 8 << 20) -> DataFrame:
    """The pieces of all whole texts, each with a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            step = max(1, int(batch.num_rows * min(1.0, max_bytes / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(at, step)])
                out: list[tuple] = []
                for doc_id, text in zip(part["doc_id"].to_pylist(), binary_column(part, "text")):
                    ids = ids_of(text.decode(), path)
                    for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                        out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), uid))
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*out))], ["doc_id", "piece", "start", "length", "ids_crc32", "uid"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECE)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item; items are taken longest first, each into the fullest bin that has room."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, count = 0, 0  # bit r is set if some bin has exactly r tokens of room
    for i in order:
        size = sizes[i]
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            left, at = capacity, count
            count += 1
        bins[i], offsets[i] = at, capacity - left
        if left > size:
            if not room[left - size]:
                open_rooms |= 1 << (left - size)
            room[left - size].append(at)
    return bins, offsets


def fit_local(rows: pa.Table, node: int, capacity: int, slack: int) -> pa.Table:
    """The pieces of a partition with their bins; done marks those in nearly full ones."""
    length, uid = rows["length"].to_numpy(), rows["uid"].to_numpy()
    bins, offsets = map(np.array, best_fit(length.tolist(), capacity))
    total = np.bincount(bins, weights=length).astype(np.int64)
    name = np.full(len(total), np.iinfo(np.int64).max)
    np.minimum.at(name, bins, uid)
    more = {"bin": name[bins], "offset": offsets, "node": np.full(len(uid), node), "done": (total >= capacity - slack)[bins]}
    for column, values in more.items():
        rows = rows.append_column(column, pa.array(values))
    return rows


def meet(rows: pa.Table, capacity: int, slack: int, small: int) -> pa.Table:
    """The bins that meet in a node as items of one round: where each goes, and how full that is then.

    small: bins of at most half the capacity in the whole level; more bins of any one larger fill find no partner."""
    old, fill = rows["bin"].to_numpy(), rows["fill"].to_numpy()
    order = np.lexsort((old, fill))
    sorted_fill = fill[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_fill, sorted_fill)
    within = np.empty(len(order), dtype=np.int64)
    within[order] = rank
    items = (2 * fill <= capacity) | (within < small)
    bins, offsets = (np.array(x, dtype=np.int64) for x in best_fit(fill[items].tolist(), capacity))
    total = np.bincount(bins, weights=fill[items]).astype(np.int64)
    name = np.full(len(total), np.iinfo(np.int64).max)
    np.minimum.at(name, bins, old[items])
    bin_, shift, full = old.copy(), np.zeros(len(old), dtype=np.int64), fill.copy()
    bin_[items], shift[items], full[items] = name[bins], offsets, total[bins]
    done = ~items | (full >= capacity - slack)
    return pa.table({"old": old, "bin": bin_, "shift": shift, "fill": full, "node": rows["node"], "done": done})


def _meeting(capacity: int, slack: int, small: int):
    return lambda rows: meet(rows, capacity, slack, small)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, fan_in: int = FAN_IN, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    slack = capacity // 64
    cut = written(pieces(docs, path, capacity), "pieces")
    whole = cut.where(F.col("length") == capacity).withColumns({"bin": F.col("uid"), "offset": F.lit(0).cast("long")})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, count = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= local_rows:
                yield from fit_local(pa.Table.from_batches(held), node, capacity, slack).combine_chunks().to_batches()
                held, count = [], 0
        if held:
            yield from fit_local(pa.Table.from_batches(held), node, capacity, slack).combine_chunks().to_batches()

    packed = written(cut.where(F.col("length") < capacity).mapInArrow(local, PACKED), "packed")
    bins = packed.where("not done").groupBy("bin").agg(F.sum("length").alias("fill"), F.max("node").alias("node"))
    moves: DataFrame | None = None
    while True:
        rows, top, least, small = bins.agg(F.count(F.lit(1)), F.max("node"), F.min("fill"), F.count_if(2 * F.col("fill") <= capacity)).first()
        if not rows:
            break
        up = bins.where(F.col("fill") <= capacity - least).withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        moved = written(up.groupBy("node").applyInArrow(_meeting(capacity, slack, small), MOVED), "moved")
        if moves is None:
            moves = moved.select("old", "bin", "shift")
        else:
            then = moved.select(F.col("old").alias("bin"), F.col("bin").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(then, "bin", "left").select("old", F.coalesce("next", "bin").alias("bin"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        if top < fan_in:
            break
        bins = moved.where("not done").groupBy("bin").agg(F.max("fill").alias("fill"), F.max("node").alias("node"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = whole.select(*columns, F.col("bin").alias("sequence_id"), "offset").unionByName(packed.where("done").select(*columns, F.col("bin").alias("sequence_id"), "offset"))
    rest = packed.where("not done")
    if moves is None:
        return out.unionByName(rest.select(*columns, F.col("bin").alias("sequence_id"), "offset"))
    goes = moves.select(F.col("old").alias("bin"), F.col("bin").alias("next"), "shift")
    climbed = rest.join(goes, "bin", "left").select(*columns, F.coalesce("next", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return out.unionByName(climbed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
