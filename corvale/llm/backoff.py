"""Language-model scoring with a weighted backoff automaton.

The model is a trigram model over words with interpolated smoothing. A history h with c(h)
training tokens after it gives p(w|h) = (1 - l) c(h,w) / c(h) + l p(w|h'), where h' is h
without its first word, down to p(w), the add-half unigram estimate with one class for
unknown words; l depends on the order and on the size class floor(log2 c(h)). Each l is the
grid value that maximises the leave-one-out likelihood of all training tokens; a token left
out counts for the size class that its history has without it.

As an automaton: the root, a state for each word (and the start of a text) and one for each
pair of words that the training texts go on from. A state has an arc for each word that
followed it, with the log-probability, and a failure arc with weight log10 l to the state of
the shorter history; the root has an arc for every word. An arc for w from a state of one or
two words leads to the state of the last word and w, one from the root to that of w. A text
is read from left to right, its end token included: at each token the carried state takes
its arc, or failure arcs until there is one, and the log-probabilities add up. Many texts are
read at a time; after ``SEGMENT`` tokens a text is read on by a further reader, which comes
to the same state by reading the two tokens before, as no state reaches further back.

Nothing of the model is broadcast, so it may grow with the corpus. Texts are gathered into
blocks of bounded bytes, written as token numbers with 64-bit hashes of the words. A block
lists its different words, pairs and triples as hashes with its own training counts (so
frequent ones are summed before any shuffle), sorted and cut into key ranges; a range sums
the counts of all blocks and answers each block in its own order. With these answers a
block has the part of the automaton that its texts can reach. Hashes of pairs and triples
are cut to 20 bits more than the corpus has tokens (48 at least), so that one of about a
million shares its count with another.

Edge cases: a null, empty or blank text has the end token alone. Texts are taken whole.
Repeated rows are trained on and scored each. A null doc_id is no training row, so
it counts as held out. Without training tokens every word is unknown. Tables without rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.llm.common import held_out, offsets_of, table, written

FOLDS, OUT_FOLD = 5, 1
#: Text bytes of a block and of a key range, on average.
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 16 << 20
#: Candidate shares of the shorter history, for each size class of a history.
GRID = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999)
CLASSES = 64
#: Tokens of a text that one reader takes.
SEGMENT = 512
#: Stands for a null doc_id inside.
NO_ID = -(1 << 63)

BLOCK = "block long, ids binary, lengths binary, train binary, token binary, word_keys binary"
COUNTED = "block long, part int, word_keys binary, word_counts binary, pair_keys binary, pair_counts binary, triple_keys binary, triple_counts binary"
ANSWERED = "block long, part int, words binary, pairs binary, triples binary, vocabulary long, tokens long"
JOINED = "ids binary, lengths binary, train binary, token binary, words binary, pairs binary, triples binary"


def _squeeze(values: np.ndarray, width: int = 8) -> bytes:
    """Unsigned integers of some bytes as compressed byte planes: high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(blob: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")


def _squeeze_sorted(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def _unsqueeze_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unsqueeze(blob), dtype=np.uint64)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def _before(token: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """The token before each, or the start mark at a text's beginning."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[starts[:-1]] = start
    return out


class Block:
    """The tokens of a block's texts by number; the last number is the end, and one more stands for the start."""

    def __init__(self, ids: np.ndarray, train: np.ndarray, lengths: np.ndarray, token: np.ndarray, word_keys: np.ndarray):
        self.ids, self.train, self.lengths, self.token, self.word_keys = ids, train, lengths, token.astype(np.int64), word_keys
        self.end, self.start = len(word_keys) - 1, len(word_keys)
        self.starts = offsets_of(lengths)
        width = self.start + 1
        self.before = _before(self.token, self.starts, self.start)
        self.pair, self._pairs = pd.factorize(self.before * width + self.token)
        pair_before = np.append(0, self.pair[:-1])
        codes = pair_before * width + self.token
        first = self.starts[:-1]
        codes[first] = -1
        self.triple, self._triples = pd.factorize(codes)
        self.pair_before = pair_before
        self.in_train = np.repeat(train, lengths)

    @staticmethod
    def of_texts(ids: np.ndarray, train: np.ndarray, texts: list[bytes]) -> Block:
        split = [t.lower().split() for t in texts]  # for bytes: A-Z only, ASCII blanks only
        words = np.array([len(s) for s in split], dtype=np.int64)
        flat = list(chain.from_iterable(split))
        del split
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        keys = np.array([xxhash.xxh64_intdigest(w) for w in (*number, b"")], dtype=np.uint64)  # no word is empty: that is the end
        starts = offsets_of(words + 1)
        token = np.full(int(starts[-1]), len(number), dtype=np.int64)
        is_word = np.ones(len(token), dtype=bool)
        is_word[starts[1:] - 1] = False
        token[is_word] = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        return Block(ids, train, words + 1, token, keys)

    def row(self, number: int) -> tuple:
        return number, self.ids.astype("<i8").tobytes(), _squeeze(self.lengths, 4), self.train.astype(np.uint8).tobytes(), _squeeze(self.token, 4), self.word_keys.tobytes()

    @staticmethod
    def of_row(row: dict) -> Block:
        return Block(np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["train"], dtype=np.uint8).astype(bool), _unsqueeze(row["lengths"], 4).astype(np.int64), _unsqueeze(row["token"], 4), np.frombuffer(row["word_keys"], dtype="<u8"))

    def keys(self, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(keys in order, that order) of words, pairs and triples; keys of pairs and triples have so many bits."""
        width = self.start + 1
        hashes = np.append(self.word_keys, np.uint64(xxhash.xxh64_intdigest(b" ")))  # no word is a blank: that is the start
        pairs = _mixed(hashes[self._pairs // width], hashes[self._pairs % width])
        some = self._triples >= 0
        triples = np.zeros(len(self._triples), dtype=np.uint64)  # key zero is that of no triple, at texts' beginnings
        triples[some] = _mixed(pairs[self._triples[some] // width], hashes[self._triples[some] % width])
        drop = np.uint64(64 - bits)
        found = [self.word_keys, pairs >> drop, triples >> drop]
        orders = [np.argsort(k, kind="stable") for k in found]
        return [(k[o], o) for k, o in zip(found, orders)]

    def counts(self, orders: list[np.ndarray]) -> list[np.ndarray]:
        """Training counts of words, pairs and triples, in order of their keys."""
        some = self.in_train
        kinds = ((self.token, len(self.word_keys)), (self.pair, len(self._pairs)), (self.triple, len(self._triples)))
        return [np.bincount(which[some], minlength=n)[order] for (which, n), order in zip(kinds, orders)]


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes in order."""
    mixed = (left ^ (left >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + right
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _range_of(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _blocking(block_bytes: int):
    """Partition function: the texts of a partition as blocks, in order."""

    def flush(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        block = Block.of_texts(rows["doc_id"].to_numpy(), rows["train"].to_numpy(), rows["text"].to_pylist())
        yield from _table([block.row(number)], BLOCK).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            step = max(1, int(batch.num_rows * min(1.0, block_bytes / 4 / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if held and size + part.nbytes > block_bytes:
                    yield from flush(held, number)
                    held, size, number = [], 0, number + 1
                held.append(part)
                size += part.nbytes
        if held:
            yield from flush(held, number)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, as they are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch[name][i].as_py() for name in batch.schema.names}


def _counting(ranges: int, bits: int):
    """Partition function: a block's keys and counts, cut into key ranges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block.of_row(row)
            keys, orders = zip(*block.keys(bits))
            parts = []
            for k, counts, wide in zip(keys, block.counts(list(orders)), (64, bits, bits)):
                cuts = np.searchsorted(_range_of(k, ranges, wide), np.arange(ranges + 1))
                parts.append([(_squeeze_sorted(k[a:b]), _squeeze(counts[a:b])) if b > a else (None, None) for a, b in zip(cuts, cuts[1:])])
            out = [(row["block"], r, *w, *p, *t) for r, (w, p, t) in enumerate(zip(*parts)) if w[0] or p[0] or t[0]]
            yield from _table(out, COUNTED).to_batches()

    return count


def _answer(rows: pa.Table) -> pa.Table:
    """Group function: totals of a key range, for each block in the order of its keys."""
    blocks, part = rows["block"].to_pylist(), rows["part"][0].as_py()
    answers, vocabulary, tokens = [], 0, 0
    for kind in ("word", "pair", "triple"):
        keys = [np.zeros(0, dtype=np.uint64) if k is None else _unsqueeze_sorted(k) for k in rows[f"{kind}_keys"].to_pylist()]
        counts = [np.zeros(0, dtype=np.uint64) if c is None else _unsqueeze(c) for c in rows[f"{kind}_counts"].to_pylist()]
        which, _ = pd.factorize(np.concatenate(keys))
        total = np.bincount(which, weights=np.concatenate(counts).astype(np.float64)).astype(np.uint64)
        if kind == "word":
            vocabulary, tokens = int((total > 0).sum()), int(total.sum())
        at = offsets_of(np.array([len(k) for k in keys])).tolist()
        answers.append([_squeeze(total[which[a:b]]) if b > a else None for a, b in zip(at, at[1:])])
    # the range's own sums go out once, with its first row
    return _table([(b, part, *found, vocabulary if i == 0 else 0, tokens if i == 0 else 0) for i, (b, *found) in enumerate(zip(blocks, *answers))], ANSWERED)


def _joining(bits: int):
    """Cogroup function: a block beside the totals of its words, pairs and triples."""

    def join(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return _table([], JOINED)
        (row,) = blocks.to_pylist()
        block = Block.of_row(row)
        answers = answers.sort_by("part")
        totals = []
        for column, (_, order) in zip(("words", "pairs", "triples"), block.keys(bits)):
            total = np.empty(len(order), dtype=np.uint64)
            total[order] = np.concatenate([_unsqueeze(a) for a in answers[column].to_pylist() if a is not None])
            totals.append(_squeeze(total))
        return _table([(*(row[c] for c in ("ids", "lengths", "train", "token")), *totals)], JOINED)

    return join


def _size_class(history: np.ndarray) -> np.ndarray:
    """floor(log2) of a history's count; 0 also for unseen ones, which have no state."""
    return np.floor(np.log2(np.maximum(history, 1))).astype(np.int64)


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    words, pairs, triples: training totals of the block's different ones, by number. States are numbered: 0 the root, then
    one for each word and for the start, then one for each pair."""

    def __init__(self, block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, tokens: int, vocabulary: int):
        self.block = block
        self.words, self.pairs, self.triples = (x.astype(np.float64) for x in (words, pairs, triples))
        self.triples[block._triples < 0] = 0  # the place of no triple
        self.norm = tokens + 0.5 * (vocabulary + 1)
        width = block.start + 1
        self.left, self.right = block._pairs // width, block._pairs % width
        some = block._triples >= 0
        self.history = np.where(some, block._triples // width, 0)  # pair of a triple's first two words
        self.tail = np.zeros(len(block._triples), dtype=np.int64)  # pair of its last two
        self.tail[block.triple] = block.pair
        self.after_word = np.append(self.words, self.words[-1])  # the start is met once in each training text
        self.after_word[block.end] = 0  # nothing follows an end
        self.after_pair = np.where(self.right == block.end, 0, self.pairs)

    def weights(self, shares: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
        """(arcs of the root, of word states, of pair states, failure arcs of word states, of pair states); arcs that are
        not there are NaN. shares: the shorter history's share by size class, for one and for two words."""
        with np.errstate(divide="ignore", invalid="ignore"):
            low = (self.words + 0.5) / self.norm
            one, two = (np.where(after > 0, share[_size_class(after)], 1.0) for after, share in zip((self.after_word, self.after_pair), shares))
            mid = np.where(self.pairs > 0, (1 - one[self.left]) * self.pairs / self.after_word[self.left] + one[self.left] * low[self.right], np.nan)
            top = np.where(self.triples > 0, (1 - two[self.history]) * self.triples / self.after_pair[self.history] + two[self.history] * mid[self.tail], np.nan)
        return np.log10(low), np.log10(mid), np.log10(top), np.log10(one), np.log10(two)

    def traverse(self, shares: tuple[np.ndarray, np.ndarray], segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of each text, read from left to right by a carried state."""
        block = self.block
        root, mid, top, fail_word, fail_pair = self.weights(shares)
        first_pair = block.start + 2
        fail = np.concatenate([[0.0], fail_word, fail_pair])
        # the state that a failure arc of a pair state leads to is that of its last word, which is the word before
        word_state = np.where(self.after_word > 0, 1 + np.arange(block.start + 1), 0)
        pair_state = np.where(self.after_pair > 0, first_pair + np.arange(len(self.pairs)), 0)
        arc_top, arc_mid, arc_root = top[block.triple], mid[block.pair], root[block.token]
        shorter, via_pair, via_root = word_state[block.before], pair_state[block.pair], word_state[block.token]
        number = -(-block.lengths // segment)
        owner = np.repeat(np.arange(len(number)), number)
        part = np.arange(len(owner)) - offsets_of(number)[owner]
        begin = block.starts[owner] + part * segment
        size = np.minimum(segment, block.starts[owner + 1] - begin)
        order = np.argsort(-size, kind="stable")  # readers that go on longest come first, so the active ones are a prefix
        begin, size, fresh = begin[order], size[order], part[order] == 0
        state = np.where(fresh, word_state[block.start], 0)
        total = np.zeros(len(order))
        active = np.searchsorted(-size, -np.arange(segment), side="left")
        for step in range(-2, segment):
            if step < 0:
                who = np.flatnonzero(~fresh)
            elif not active[step]:
                break
            else:
                who = slice(0, int(active[step]))
            now = state[who]
            if not len(now):
                continue
            at = begin[who] + step
            gained = np.zeros(len(now))
            pair = now >= first_pair
            by_top = pair & ~np.isnan(arc_top[at])
            falls = pair & ~by_top
            gained += np.where(falls, fail[now], 0.0)
            now = np.where(falls, shorter[at], now)
            word = (now > 0) & ~by_top
            by_mid = word & ~np.isnan(arc_mid[at])
            falls = word & ~by_mid
            gained += np.where(falls, fail[now], 0.0)
            gained += np.where(by_top, arc_top[at], np.where(by_mid, arc_mid[at], arc_root[at]))
            state[who] = np.where(by_top | by_mid, via_pair[at], via_root[at])
            if step >= 0:
                total[who] += gained
        return np.bincount(owner[order], weights=total, minlength=len(number))

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """(unigram log10 probability, known tokens) of each text."""
        root, starts = np.log10((self.words + 0.5) / self.norm), self.block.starts[:-1]
        return np.add.reduceat(root[self.block.token], starts), np.add.reduceat((self.words > 0)[self.block.token].astype(np.int64), starts)

    def leave_one_out(self, words: int, word_shares: np.ndarray | None = None) -> np.ndarray:
        """(size classes × grid) log-likelihood of the training texts' tokens, each without itself, after histories of one
        or two words; for two the shares of one word are given."""
        block = self.block
        some = np.flatnonzero(block.in_train & (block.triple != block.triple[0])) if words == 2 else np.flatnonzero(block.in_train)
        low = (self.words[block.token[some]] - 0.5) / (self.norm - 1)
        rest = self.after_word[block.before[some]] - 1
        seen = (self.pairs[block.pair[some]] - 1) / np.maximum(rest, 1)
        if words == 2:
            share = np.where(rest > 0, word_shares[_size_class(rest)], 1.0)
            low = (1 - share) * seen + share * low
            rest = self.after_pair[block.pair_before[some]] - 1
            seen = (self.triples[block.triple[some]] - 1) / np.maximum(rest, 1)
        some = rest > 0  # a history that was met here only says nothing
        low, seen, sizes = low[some], seen[some], _size_class(rest[some])
        return np.stack([np.bincount(sizes, weights=np.log10((1 - g) * seen + g * low), minlength=CLASSES) for g in GRID], axis=1)


def _automata(batches: Iterator[pa.RecordBatch], tokens: int, vocabulary: int) -> Iterator[Automaton]:
    for row in _rows(batches):
        totals = [_unsqueeze(row[c]) for c in ("words", "pairs", "triples")]
        yield Automaton(Block.of_row({**row, "word_keys": bytes(8 * len(totals[0]))}), *totals, tokens, vocabulary)


def joined_blocks(docs: DataFrame, train, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int, int]:
    """(the blocks with their totals, written to the shared folder; training tokens; different ones)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    ranges, bits = max(1, -(-size // range_bytes)), min(64, max(48, (size // 4).bit_length() + 20))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), text.alias("text"))
    blocks = written(rows.mapInArrow(_blocking(block_bytes), BLOCK), "blocks")
    answers = written(blocks.mapInArrow(_counting(ranges, bits), COUNTED).groupBy("part").applyInArrow(_answer, ANSWERED), "answers")
    vocabulary, tokens = (x or 0 for x in answers.agg(F.sum("vocabulary"), F.sum("tokens")).first())
    joined = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_joining(bits), JOINED)
    return written(joined, "joined"), tokens, vocabulary


def fitted(blocks: DataFrame, tokens: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The shares by size class, for histories of one and of two words: of equal ones the larger, for a class that no
    token tells of that of the class above or below."""
    out: list[np.ndarray] = []
    schema = "size int, share int, total double"
    for words in (1, 2):

        def likelihoods(batches: Iterator[pa.RecordBatch], words: int = words, known: tuple = tuple(out)) -> Iterator[pa.RecordBatch]:
            for automaton in _automata(batches, tokens, vocabulary):
                found = automaton.leave_one_out(words, *known)
                yield from _table([(k, g, float(found[k, g])) for k in np.flatnonzero(found.any(1)) for g in range(len(GRID))], schema).to_batches()

        shares, best = np.full(CLASSES, np.nan), np.full(CLASSES, -np.inf)
        for size, share, total in blocks.mapInArrow(likelihoods, schema).groupBy("size", "share").agg(F.round(F.sum("total"), 3).alias("total")).orderBy("size", "share").collect():
            if total >= best[size]:
                best[size], shares[size] = total, GRID[share]
        out.append(pd.Series(shares).ffill().bfill().fillna(GRID[-1]).to_numpy())
    return out[0], out[1]


def scores(docs: DataFrame, train=None, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    train = ~held_out(FOLDS, OUT_FOLD) if train is None else train
    blocks, tokens, vocabulary = joined_blocks(docs, train, block_bytes, range_bytes)
    shares = fitted(blocks, tokens, vocabulary)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for automaton in _automata(batches, tokens, vocabulary):
            base, known = automaton.base()
            block = automaton.block
            found = {"doc_id": block.ids, "train": block.train, "n_tokens": block.lengths, "n_known": known, "base_score": base, "score": automaton.traverse(shares)}
            yield from pa.table({name: pa.array(values) for name, values in found.items()}).to_batches()

    out = blocks.mapInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
