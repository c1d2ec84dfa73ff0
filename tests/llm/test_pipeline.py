"""The corpus pipeline, stage by stage, against brute force."""

import re
import shutil

import xxhash

import corpus_pipeline
from corvale.llm import common, packing, quality, toxicity
from corvale.llm.bpe import default_tokenizer

DIR = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, DIR)
        assert out.columns == names
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert after and after.items() <= before.items(), name
        if name == "exact_dedup":
            bare = {}
            for i, t in sorted(before.items()):
                bare.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
            assert set(after) == {min(v)[1] for v in bare.values()}
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r["doc_id"] for r in packed.collect()} == set(after)
    assert packed.count() == corpus_pipeline.run(spark, DIR).count()


def test_a_run_deletes_its_own_tables_only(spark):
    held = toxicity.query(spark, DIR)
    before = common.made()
    assert corpus_pipeline.run(spark, DIR).count() > 0
    left = common.made()
    assert before <= left and len(left - before) == 1  # the last stage's result
    assert held.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_rejections_take_effect(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels))
    assert {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, DIR).collect()} == {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert {r["doc_id"] for r in corpus_pipeline.keep_clean(spark, docs, DIR).collect()} == {r["doc_id"] for r in scored.where("not flagged").collect()}


def print_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def order(row):
    return row["doc_id"] is None, row["doc_id"] or 0


def brute_run(rows, good, clean):
    """The rows that stay, by plain loops; good and clean tell what the trained stages think of a text."""
    rows = [r for r in rows if clean(r) and good(r)]
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    rows = [min(g, key=lambda r: (-len(r["text"] or ""), order(r))) for g in groups.values()]
    prints = [print_of(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min(g, key=order) for g in groups.values()]


def test_run_against_plain_loops(spark, tmp_path):
    """The whole pipeline on a table with null and repeated ids, repeated rows, empty and blank texts and copies."""
    for name in ("documents", "labels"):
        frame = spark.read.parquet(f"{DIR}/{name}.parquet")
        if name == "documents":
            some = frame.orderBy("doc_id").limit(120)
            odd = [(None, "no id but words", "en", "s", 1), (None, "no id but words", "en", "s", 1), (None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6, "\t \n", "en", "s", 3)]
            first = some.first()
            odd += [tuple(first), tuple(first), (None, *tuple(first)[1:]), (10**6 + 1, first["text"] + " ", *tuple(first)[2:]), (first["doc_id"], "an other text of that id", "en", "s", 2)]
            frame = some.unionByName(spark.createDataFrame(odd, frame.schema))
        frame.coalesce(2).write.parquet(f"{tmp_path}/{name}.parquet")
    place = str(tmp_path)
    docs, labels = (spark.read.parquet(f"{place}/{n}.parquet") for n in ("documents", "labels"))
    judge = quality.train(docs, labels)
    rows = docs.collect()
    good = lambda r: float(judge.score(quality.np.array([quality.statistics((r["text"] or "").encode())]))[0]) >= quality.CUT
    kept = spark.createDataFrame([r for r in rows if good(r)], docs.schema)
    guard = toxicity.train(kept, labels)
    clean = lambda r: float(guard.score([(r["text"] or "").encode()])[0]) < guard.threshold(r["lang"])
    want = brute_run(rows, good, clean)
    found = corpus_pipeline.run(spark, place).collect()
    pieces = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["length"], r["ids_crc32"]) for r in found)
    expected = []
    for r in want:
        ids = packing.ids_of(r["text"] or "", default_tokenizer())
        for piece, (start, length) in enumerate(packing.cuts(len(ids), packing.CAPACITY)):
            expected.append((r["doc_id"] if r["doc_id"] is not None else -1, piece, length, packing.zlib.crc32(ids[start : start + length].tobytes())))
    assert pieces == sorted(expected)
    shutil.rmtree(place)
