"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

Text is cut by the vocabulary file's added tokens and then by its split pattern. The
words that a batch needs and the cache lacks are encoded together: the symbols of all
of them lie in one flat array; each round looks up every neighbouring pair by binary
search over the sorted pair keys, takes each word's lowest rank and merges all its
occurrences from the left. Words leave the array when no pair is known. Words over
``LONG_WORD`` bytes have rounds of their own over a linked array, in which a round costs
as much as it merges, so a text without blanks takes time in proportion to its length.
Decoding gathers the bytes of the ids from one flat table.

Edge cases: a null text counts as empty and has no ids. Texts are taken whole, also
those without blanks. Tables without rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvale.llm.common import binary_column, each_batch, offsets_of, table

#: Words whose ids a worker remembers; beyond it the cache starts anew.
CACHE_WORDS = 400_000
#: Bytes beyond which a word is encoded in rounds of its own.
LONG_WORD = 1024
_NONE = np.iinfo(np.int64).max


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies use for each byte, reversed: printable bytes stand for themselves, the rest count up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.added = added
        self._added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._split = regex.compile(public_tokenizers.PATTERN)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self._base = len(self.bytes_of)
        keys = np.array([vocab[a] * self._base + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.rank_keys = keys
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.pair_ids = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.token_lengths, self.token_starts = lengths, offsets_of(lengths)[:-1]
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.decimals = [str(i) for i in range(len(self.bytes_of))]
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The words that are encoded one by one; an added token is a word of its own."""
        if self._added is None or not any(t in text for t in self.added):
            return self._split.findall(text)
        out: list[str] = []
        for i, part in enumerate(self._added.split(text)):
            out += [part] if i % 2 else self._split.findall(part)
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, start of each word's ids and the end of the last)."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            keys = np.where(owner[:-1] == owner[1:], symbols[:-1] * self._base + symbols[1:], -1)
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            ranks = np.append(np.where(self.pair_keys[place] == keys, self.pair_ranks[place], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            over = lowest == _NONE
            if over.any():
                done.append((owner[over], symbols[over]))
                symbols, owner, ranks, lowest = symbols[~over], owner[~over], ranks[~over], lowest[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == lowest)
            run = np.append(True, np.diff(at) != 1)
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            symbols[at] = self.pair_ids[ranks[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owners = np.concatenate([o for o, _ in done]) if done else np.zeros(0, dtype=np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, dtype=np.int64)
        return ids[np.argsort(owners, kind="stable")], offsets_of(np.bincount(owners, minlength=len(words)))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; _NONE for unknown pairs and those with a missing side."""
        keys = np.where((left >= 0) & (right >= 0), left * self._base + right, -1)
        place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == keys, self.pair_ranks[place], _NONE)

    def encode_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: each round takes the lowest rank left and merges its occurrences."""
        n = len(word)
        symbols = np.append(self.byte_ids[np.frombuffer(word, dtype=np.uint8)], -1)  # the last entry stands for both ends
        after, before = np.append(np.arange(1, n + 1), n), np.append(np.arange(-1, n - 1), n)
        before[0] = n
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            ranks = self._ranks(symbols[places], symbols[after[places]])
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else ranks
            for some, rank in zip(np.split(places, cuts[1:]), ranks[cuts].tolist()):
                if rank != _NONE:
                    if rank not in waiting:
                        heapq.heappush(heap, rank)
                    waiting.setdefault(rank, []).append(some)

        wait(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[symbols[at] >= 0]
            at = at[(symbols[after[at]] >= 0) & (symbols[at] * self._base + symbols[after[at]] == self.rank_keys[rank])]
            if not len(at):
                continue
            index = np.arange(len(at))
            run = np.append(True, after[at[:-1]] != at[1:])
            at = at[(index - np.maximum.accumulate(np.where(run, index, 0))) % 2 == 0]
            gone = after[at]
            symbols[at], symbols[gone] = self.pair_ids[rank], -1
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            wait(np.unique(np.concatenate([left[left < n], at])))
        return symbols[symbols >= 0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list(set().union(*cut).difference(self.cache))
        for token in [w for w in new if w in self.added]:
            self.cache[token] = np.int32(self.added[token]).tobytes()
        new = [w for w in new if w not in self.added]
        for word in [w for w in new if len(w.encode()) > LONG_WORD]:
            self.cache[word] = self.encode_long(word.encode()).astype("<i4").tobytes()
        new = [w for w in new if w not in self.cache]
        ids, starts = self.encode_words([w.encode() for w in new])
        flat, ends = ids.astype("<i4").tobytes(), (starts * 4).tolist()
        self.cache.update(zip(new, [flat[a:b] for a, b in zip(ends, ends[1:])]))
        known = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(known, words)), dtype="<i4") for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, added tokens included; bytes that are not UTF-8 become U+FFFD."""
        lengths = self.token_lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.token_starts[ids] - (ends - lengths), lengths) + np.arange(total)
        return self.token_bytes[source].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    """The vocabulary at path, read once for each worker."""
    return ByteBPE(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def work(rows: pa.Table) -> pa.Table:
        ids = vocabulary(path).encode_batch([t.decode() for t in binary_column(rows, "text")])
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype="<i4")
        return pa.table({"doc_id": rows["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(offsets_of(np.array([len(i) for i in ids])).astype(np.int32)), pa.array(flat.astype(np.int32)))})

    return each_batch(_texts(docs), work, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with ids array<int>; null ids give a null text."""

    def work(rows: pa.Table) -> pa.Table:
        known = vocabulary(path)
        return pa.table({"doc_id": rows["doc_id"], "text": pa.array([None if i is None else known.decode(np.array(i, dtype=np.int64)) for i in rows["ids"].to_pylist()], pa.string())})

    return each_batch(ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that decodes from them; one pass, nothing but digests leaves the workers."""

    def work(rows: pa.Table) -> pa.Table:
        known = vocabulary(path)
        ids = known.encode_batch([t.decode() for t in binary_column(rows, "text")])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        name = known.decimals.__getitem__
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "n_tokens": pa.array([len(i) for i in ids], pa.int64()),
                "ids_sha256": pa.array([sha(",".join(map(name, i.tolist()))) for i in ids], pa.string()),
                "decoded_sha256": pa.array([sha(known.decode(i)) for i in ids], pa.string()),
            }
        )

    return each_batch(_texts(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 4 << 20)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_tokenizer())
