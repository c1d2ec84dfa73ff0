"""BPE, packing, sharding and language-model scoring against brute force."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvale.llm import backoff, bpe, packing, sharding

DOCS = "doc_id long, text string, lang string, shard string, length long"
TEXTS = ["Hello world", "", None, " ", "  two  spaces\n\nlines", "l'été où 123 ²½ x_y", "<|endoftext|>a<|endoftext|>", "a" * 3000, "日本語 の テキスト", "word " * 3000, "é   nb", "😀!!?? :)"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_ids_and_round_trip(spark, library):
    found = {r["doc_id"]: r for r in bpe.round_trip(frame(spark), bpe.default_tokenizer()).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoded_and_decoded_frames(spark):
    path = bpe.default_tokenizer()
    ids = bpe.encoded(frame(spark), path)
    assert {r["doc_id"]: r["text"] for r in bpe.decoded(ids, path).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encoded(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop", "é日", "=", " ", "0123456789"])
def test_long_words_take_rounds_of_their_own(library, letters):
    known = bpe.ByteBPE(bpe.default_tokenizer())
    picks = np.random.default_rng(3).integers(0, len(letters), 60_000)
    text = "".join(letters[i] for i in picks)
    assert known.encode_batch([text, "a " + text[:2000]])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    word = text[:1500].encode()
    assert known.encode_long(word).tolist() == known.encode_words([word])[0].tolist()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text_decodes_to_itself(text):
    known = bpe.vocabulary(bpe.default_tokenizer())
    assert known.decode(known.encode_batch([text])[0]) == text


def packed(spark, texts, **more):
    return packing.pack(frame(spark, texts), bpe.default_tokenizer(), **more).collect()


@pytest.mark.parametrize("more", [{}, {"capacity": 64, "fan_in": 2}, {"capacity": 64, "fan_in": 2, "local_rows": 5}])
def test_packing(spark, library, more):
    capacity = more.get("capacity", 2048)
    texts = TEXTS + [" ".join(["tok"] * n) for n in (capacity - 1, capacity, 2 * capacity - 1, *range(1, 90))]
    rows = packed(spark, texts, **more)
    by = collections.defaultdict(list)
    fill = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(math.ceil(len(ids) / capacity)))
        assert sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["piece"] == 0 or r["length"] == capacity
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(fill) <= 1.05 * math.ceil(sum(r["length"] for r in rows) / capacity) + 1


def test_best_fit_uses_the_fullest_bin():
    bins, offsets = packing.best_fit([5, 7, 3, 5], 10)
    assert bins == [1, 0, 0, 1] and offsets == [0, 0, 7, 5]
    assert packing.cuts(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)] and packing.cuts(1, 4) == [(0, 1)]


def test_packing_of_odd_rows(spark, library):
    """Null ids and repeated rows are packed each; names of further columns clash with those inside."""
    rows = [(None, "same text", None, "x", 1), (None, "same text", None, "x", 1), (1, None, None, "x", 1), (1, "same text", None, "x", 2)]
    found = packing.pack(spark.createDataFrame(rows, DOCS), bpe.default_tokenizer()).collect()
    n = len(library.encode("same text", add_special_tokens=False).ids) + 1
    assert sorted((r["doc_id"] or -1, r["length"]) for r in found) == [(-1, n), (-1, n), (1, 1), (1, n)]
    assert len({r["sequence_id"] for r in found}) == 1 and sorted(r["offset"] for r in found)[0] == 0


@pytest.mark.parametrize("unit, times", [(" ", 2_000_000), ("\n", 2_000_000), ("a", 2_000_000), (" \t", 700_000), ("\u00a0 ", 700_000), ("word   ", 300_000)])
def test_ids_of_very_long_runs(library, unit, times):
    text = "start" + unit * times + "end of it"
    assert packing.ids_of(text, bpe.default_tokenizer()).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_packing_survives_a_run_of_blanks(spark, library):
    text = "a" + " " * 1_200_000 + "b"
    found = packed(spark, [text, "tail"])
    assert sum(r["length"] for r in found if r["doc_id"] == 0) == len(library.encode(text, add_special_tokens=False).ids) + 1


def test_bins_that_meet_keep_the_least_number_of_sequences():
    """Closing fills beyond the number of small bins leaves the number of sequences as it is without closing."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        fill = np.append(rng.choice([40, 45, 50, 55], 60), rng.integers(1, 33, rng.integers(0, 5))).astype(np.int64)
        rows = packing.pa.table({"bin": np.arange(len(fill)), "fill": fill, "node": np.zeros(len(fill), dtype=np.int64)})
        small = int((2 * fill <= 64).sum())
        ends = [packing.meet(rows, 64, 1, n) for n in (small, len(fill))]
        assert len(set(ends[0]["bin"].to_pylist())) == len(set(ends[1]["bin"].to_pylist()))


def test_packing_of_an_empty_table(spark):
    assert packed(spark, []) == []


def draw(key, level, node, weight):
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    for value in (level, node):
        h = xxhash.xxh64_intdigest(struct.pack("<i", value), h)
    return -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight


def slow_place(key, tree):
    total = lambda rack: sum(w for _, w in rack)
    i = min(range(len(tree.regions)), key=lambda i: draw(key, 1, i, sum(map(total, tree.regions[i])))) if len(tree.regions) > 1 else 0
    racks = tree.regions[i]
    j = min(range(len(racks)), key=lambda j: draw(key, 2, i << 16 | j, total(racks[j])))
    return min(racks[j], key=lambda s: draw(key, 3, *s))[0]


def test_sharding_against_the_tree(spark):
    texts = [f"text {i % 7}" if i % 3 else None for i in range(600)]
    found = sharding.assign(frame(spark, texts)).collect()
    tree = sharding.Tree.even(24)
    slots = collections.defaultdict(list)
    for r in found:
        text = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 8, zlib.crc32(text), "key")
        assert r["shard"] == slow_place(r["doc_id"], tree) and r["grown_shard"] == slow_place(r["doc_id"], tree.grown())
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_each_added_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    placed = rows.select(*[sharding.place(rows["k"], sharding.Tree.of(n)).alias(str(n)) for n in range(24, 29)]).collect()
    for n in range(24, 28):
        moved = [r[str(n + 1)] for r in placed if r[str(n)] != r[str(n + 1)]]
        assert moved and set(moved) == {n}


def test_sharding_of_null_and_repeated_ids(spark):
    found = sharding.assign(spark.createDataFrame([(None, "a")] * 40 + [(7, "b")] * 5 + [(7, None)], "doc_id long, text string")).collect()
    assert len(found) == 46 and len({r["shard"] for r in found if r["doc_id"] is None}) == 1 == len({r["shard"] for r in found if r["doc_id"] == 7})
    for shard in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_ids_of_null_and_repeated_rows(spark, library):
    found = bpe.round_trip(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "a b")], "doc_id long, text string"), bpe.default_tokenizer()).collect()
    n = len(library.encode("a b", add_special_tokens=False).ids)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == [(0, n), (0, n), (1, 0), (1, n)]


def test_changed_weights_move_rows_only_at_that_subtree(spark):
    rows = spark.range(4000).withColumnRenamed("id", "k")
    tree = sharding.Tree.even(24)
    other = tree.weighted(5, 3.0)
    moved = [(r["a"], r["b"]) for r in rows.select(sharding.place(rows["k"], tree).alias("a"), sharding.place(rows["k"], other).alias("b")).where("a <> b").collect()]
    assert moved and all(b in range(12) for _, b in moved)  # region 0 holds shards 0 to 11
    assert all(a in range(12, 24) or b in (4, 5, 6, 7) for a, b in moved)


def test_slots_with_small_buckets_and_odd_rows(spark):
    rows = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (2, "")] + [(i, "t") for i in range(3, 500)], "doc_id long, text string")
    placed = sharding.with_slots(rows.withColumn("shard", rows["doc_id"] % 3), "shard", "doc_id", bucket_rows=20).collect()
    by = collections.defaultdict(list)
    for r in placed:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(by[k]) == list(range(len(by[k]))) for k in (0, 1, 2))
    assert sharding.assign(frame(spark, [])).count() == 0


def brute_lm(texts):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    grams = collections.Counter(g for i in train for n in (1, 2, 3) for g in zip(*(["<s>", *tokens[i]][k:] for k in range(n))))
    return tokens, set(train), grams


def brute_probability(grams, n, v, history, w, shares):
    """The interpolated probability by its definition; history: up to two words."""
    if not history:
        return (grams[(w,)] + 0.5) / (n + 0.5 * (v + 1))
    after = sum(c for g, c in grams.items() if len(g) == len(history) + 1 and g[:-1] == history)
    lower = brute_probability(grams, n, v, history[1:], w, shares)
    if not after:
        return lower
    share = shares[len(history) - 1][int(math.log2(after))]
    return (1 - share) * grams[(*history, w)] / after + share * lower


def brute_shares(tokens, train, grams, n, v):
    after = collections.Counter()
    for g, c in grams.items():
        if len(g) > 1:
            after[g[:-1]] += c
    shares = []
    for words in (1, 2):
        total = collections.defaultdict(lambda: np.zeros(len(backoff.GRID)))
        for i in train:
            line = ["<s>", *tokens[i]]
            for at in range(words, len(line)):
                history, w = tuple(line[at - words : at]), line[at]
                low = (grams[(w,)] - 0.5) / (n + 0.5 * (v + 1) - 1)
                rest = after[history[-1:]] - 1
                if words == 2:
                    share = shares[0][int(math.log2(rest))] if rest > 0 else 1.0
                    low = (1 - share) * (grams[(*history[-1:], w)] - 1) / max(rest, 1) + share * low
                    rest = after[history] - 1
                if rest > 0:
                    seen = (grams[(*history, w)] - 1) / rest
                    total[int(math.log2(rest))] += [math.log10((1 - g) * seen + g * low) for g in backoff.GRID]
        best, last = [None] * backoff.CLASSES, None
        for size, sums in total.items():
            sums = np.round(sums, 3)
            best[size] = backoff.GRID[max(k for k in range(len(sums)) if sums[k] == sums.max())]
        for k in range(backoff.CLASSES):
            last = best[k] = best[k] if best[k] is not None else last
        known = next((x for x in best if x is not None), backoff.GRID[-1])
        shares.append([known if x is None else x for x in best])
    return shares


def test_lm_scores(spark):
    rng = np.random.default_rng(1)
    words = [f"w{n}" for n in range(40)]
    texts = {i: " ".join(words[int(k)] for k in (rng.zipf(1.5, rng.integers(0, 60)) - 1) % 40) for i in range(120)}
    texts |= {200: None, 201: "", 202: "Unseen W1 w2 w3", 203: texts[3], 204: "w1 " * 1500, 205: " ".join([*words] * 30)}
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in texts.items()], "doc_id long, text string, score double")
    found = {r["doc_id"]: r for r in backoff.scores(docs, block_bytes=3000, range_bytes=2000).collect()}
    one = {r["doc_id"]: r for r in backoff.scores(docs.coalesce(1)).collect()}
    tokens, train, grams = brute_lm(texts)
    count = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "<s>"}
    grams = {g: c for g, c in grams.items() if g != ("<s>",)}
    grams = collections.Counter(grams)
    n, v = sum(count.values()), len(count)
    shares = brute_shares(tokens, train, grams, n, v)
    cache = {}
    held = better = 0.0
    for i in texts:
        r = found[i]
        assert r["held_out"] == (i not in train) and r["n_tokens"] == len(tokens[i]) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in count for w in tokens[i])
        base = sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        line, score = ["<s>", *tokens[i]], 0.0
        for at in range(1, len(line)):
            key = (*line[max(0, at - 2) : at], line[at])
            if key not in cache:
                cache[key] = math.log10(brute_probability(grams, n, v, key[:-1], key[-1], shares))
            score += cache[key]
        assert r["score"] == pytest.approx(score, rel=1e-9)
        assert one[i]["score"] == pytest.approx(score, rel=1e-9)
        if i in train:
            held, better = held + base, better + r["score"]
    assert better > held


def test_lm_readers_come_to_the_same_state():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 9, n)).encode() for n in (0, 1, 2, 3, 50, 700)]
    block = backoff.Block.of_texts(np.arange(6), np.array([True, True, False, True, True, False]), texts)
    totals = block.counts([np.arange(len(x)) for x in (block.word_keys, block._pairs, block._triples)])
    known = backoff.Automaton(block, *totals, int(totals[0].sum()), int((totals[0] > 0).sum()))
    shares = (np.full(64, 0.4), np.full(64, 0.7))
    whole = known.traverse(shares, 10_000)
    for segment in (2, 3, 7, 64):
        assert known.traverse(shares, segment) == pytest.approx(whole, rel=1e-12)


def test_lm_probabilities_sum_to_one():
    """The next words after any history, unknown ones as one class, share all of the probability."""
    lines = [["a", "b", "a", "c"], ["a", "b", "b"], ["c", "a"]]
    grams = collections.Counter(g for t in lines for k in (1, 2, 3) for g in zip(*(["<s>", *t, None][j:] for j in range(k))))
    del grams[("<s>",)]
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    shares = [[0.3] * 64, [0.6] * 64]
    for history in ([], ["a"], ["b"], ["a", "b"], ["c", "c"], ["zz", "a"], ["b", "a", "zz"]):
        line = ("<s>", *history)
        assert sum(brute_probability(grams, n, v, line[-2:], w, shares) for w in ("a", "b", "c", "zz", None)) == pytest.approx(1.0)
        block = backoff.Block.of_texts(np.arange(4), np.array([True] * 3 + [False]), [" ".join(t).encode() for t in (*lines, history)])
        totals = block.counts([np.arange(len(x)) for x in (block.word_keys, block._pairs, block._triples)])
        known = backoff.Automaton(block, *totals, int(totals[0].sum()), int((totals[0] > 0).sum()))
        want = sum(math.log10(brute_probability(grams, n, v, (*line, None)[max(0, at - 2) : at], (*line, None)[at], shares)) for at in range(1, len(line) + 1))
        assert known.traverse(tuple(map(np.array, shares)))[3] == pytest.approx(want)


def test_lm_of_odd_tables(spark):
    assert backoff.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = backoff.scores(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) for r in alone] == [(None, True, 3, 0)] * 2
