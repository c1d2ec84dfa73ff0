"""Exact, SimHash and lattice de-duplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from corvale.llm import common, exact_dedup, lattice, simhash
from corvale.llm.components import components

DOCS = "doc_id long, text string, lang string, kept boolean, digest string, stay_id int"


def docs_frame(spark, rows):
    """Documents with further columns whose names clash with those inside the operators."""
    return spark.createDataFrame([(i, t, None, None, "x", 1) for i, t in rows], DOCS)


TEXTS = ["a b c", "abc", "a  b\tc\n", "abcd", None, "", " \t\n", "é ü", "éü", "a b", "x" * 50_000, "same", "same", "same"]


def brute_groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = set()
    for bare, members in by.items():
        keep = min(members)[3]
        for *_, i in members:
            out.add((i, keep, len(members), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    return out


def test_exact_groups(spark):
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(None, "abcd"), (99, "same"), (99, "same")]
    found = exact_dedup.groups(docs_frame(spark, rows))
    assert {tuple(r) for r in found.collect()} == brute_groups(rows)
    assert found.count() == len(rows)


def test_exact_heavy_group_takes_the_broadcast_way(spark):
    rows = [(n, "hot  text" if n % 3 == 0 else f"text {n}") for n in range(3000)]
    docs = docs_frame(spark, rows)
    assert [r["digest"] for r in exact_dedup.frequent(exact_dedup.digests(docs)).collect()] == [hashlib.sha256(b"hottext").hexdigest()]
    assert {tuple(r) for r in exact_dedup.groups(docs).collect()} == brute_groups(rows)


def test_exact_keep_best_returns_whole_rows(spark):
    kept = exact_dedup.keep_best(docs_frame(spark, [(1, "a b"), (2, "ab"), (3, "c")]))
    assert kept.columns == ["doc_id", "text", "lang", "kept", "digest", "stay_id"]
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, "a b"), (3, "c")}


def test_empty_tables(spark):
    none = docs_frame(spark, [])
    assert exact_dedup.groups(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(values, linked):
    names = sorted(values)
    low = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if linked(values[a], values[b]) and low[b] > low[a]:
                    low[b], changed = low[a], True
    return low


def test_fingerprints_equal_the_definition():
    for text in [*TEXTS, "One TWO three four ÉÀ", "w " * 1000, "a b"]:
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("caps", [(64, 512), (1, 512), (1, 1)])
def test_simhash_components(spark, caps):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{rng.integers(0, 10**6)}" for _ in range(120)) for _ in range(15)]
    texts = base + [b.replace("w1", "W1", 1) for b in base[:5]] + [b + " tail" for b in base] + [None, "", "x"]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_frame(spark, rows), list_cap=caps[0], fine_cap=caps[1]).collect()}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    assert found == brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)


def test_links_of_close_fingerprints_by_both_ways(spark):
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre}
    for _ in range(150):
        p = centre
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    signed = {p: p - (1 << 64) if p >= 1 << 63 else p for p in prints}
    distinct = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    want = brute_components({s: p for p, s in signed.items()}, lambda a, b: (a ^ b).bit_count() <= 2)
    sizes = lambda names: sorted(list(names).count(n) for n in set(names))
    every = {(min(a, b), max(a, b)) for a, p in zip(signed.values(), signed) for b, q in zip(signed.values(), signed) if a != b and (p ^ q).bit_count() <= 2}
    for caps in ((256, 512), (4, 512), (4, 2)):
        found = simhash.links(distinct, *caps)
        if caps[1] == 512:
            assert {tuple(r) for r in found.collect()} == every
        roots = {r["node"]: r["root"] for r in components(found).collect()}
        got = {s: roots.get(s, s) for s in signed.values()}
        assert got == want
        assert sizes(got.values()) == sizes(want.values())


def test_tally_counts_the_positions_of_the_lists(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(a) ^ sum(int(rng.integers(1, 256)) << 8 * int(p) for p in rng.choice(8, rng.integers(0, 5), replace=False))) for a in rng.integers(0, 1 << 62, 60)]
    pairs = [(a, b if b < 1 << 63 else b - (1 << 64)) for a, b in pairs]
    same = lambda a, b: [p for p in range(8) if not (a ^ b) >> 8 * p & 0xFF]
    met = [(a, b, k) for a, b in pairs for k in simhash.COARSE if all(p in same(a, b) for p in range(8) if k >> p & 1)]
    found = simhash.tally(spark.createDataFrame(met, "a long, b long, kept int")).collect()
    assert {(r["a"], r["b"]): r["shared"] for r in found} == {(a, b): len(same(a, b)) for a, b, _ in met}


def test_simhash_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "A b c d"), (4, "a b c d"), (4, "a b c d"), (2, "other words to read"), (None, "alone in the world of words"), (9, None), (8, "")]
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs_frame(spark, rows)).collect()), key=repr)
    assert found == sorted([(None, 4), (None, 4), (4, 4), (4, 4), (2, 2), (None, None), (9, 8), (8, 8)], key=repr)


def test_exact_group_of_a_hundredth_outside_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "frequent", lambda rows: rows.select("digest").limit(0))
    rows = [(n, "often met" if n % 100 == 0 else f"text {n}") for n in range(2000)]
    assert {tuple(r) for r in exact_dedup.groups(docs_frame(spark, rows)).collect()} == brute_groups(rows)


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Absent:
        isDefined = staticmethod(lambda: False)  # noqa: N815

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:  # noqa: N801
                sc = staticmethod(lambda: type("c", (), {"getCheckpointDir": staticmethod(lambda: Absent)}))

        conf = type("conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_simhash_keep_first(spark):
    kept = simhash.keep_first(docs_frame(spark, [(5, "a b c d"), (3, "A b c d"), (7, "else where now")]))
    assert {r["doc_id"] for r in kept.collect()} == {3, 7}
    assert kept.columns[:3] == ["doc_id", "text", "lang"]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, n) for n in range(1001, 1100)]
    found = components(spark.createDataFrame(path + star + [(5, 5), (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {**{i: 0 for i in range(41)}, **{n: 1000 for n in range(1000, 1100)}}


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_vectors(rows, cosine=0.93):
    good = {i: (np.array(e, dtype=np.float32).astype(float), l) for i, e, l in rows if l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)}
    near = lambda a, b: a[1] == b[1] and len(a[0]) == len(b[0]) and a[0] @ b[0] / np.linalg.norm(a[0]) / np.linalg.norm(b[0]) >= cosine
    low = brute_components(good, near)
    return {i: (sum(near(good[i], good[j]) for j in good if j != i) if i in good else 0, low.get(i, i)) for i, _, _ in rows}


@pytest.mark.parametrize("chunk", [1024, 7])
def test_lattice_links_and_components(spark, chunk):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    rows = [(n, (centres[n % 12] + rng.normal(size=32) * 0.12).tolist(), n % 12 % 2) for n in range(150)]
    rows += [(200 + n, rows[0][1], 0) for n in range(20)]  # copies
    rows += [(300, None, 1), (301, [0.0] * 32, 1), (302, [float("nan")] * 32, 0), (303, [1.0, None] * 16, 0), (304, rows[0][1], None), (305, [], 1), (306, [1.0] * 8, 0), (307, [float("inf")] + [0.0] * 31, 1)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(vectors_frame(spark, rows), chunk=chunk).collect()}
    want = brute_vectors(rows)
    assert set(found) == set(want)
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in found.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(found[i] == (0, i) for i in range(300, 308))
    if sum(n for n, _ in found.values()) == sum(n for n, _ in want.values()):
        assert found == want


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * n
    labels = np.zeros(len(a), dtype=np.int64)
    x, y = lattice.cells(a, labels), lattice.cells(b, labels)
    met = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any((1, 2))
    assert met.mean() > 0.97


def test_e8_points_are_nearest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)) * 3
    home = lattice.nearest_e8(x)
    d = ((x - home) ** 2).sum(1)
    assert (((x[:, None] - home[:, None] - lattice.ROOTS[None]) ** 2).sum(2) >= d[:, None] - 1e-9).all()
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(1), 2)


SAME = [(None, "one two three"), (None, "lone words here"), (1, "one two three"), (2, "copy of a text"), (3, "copy of a text"), (3, "a longer and other text"), (4, "twice met"), (4, "twice met"), (5, "a b"), (5, "a\tb"), (None, "null twin"), (None, "null twin")]
LEFT = [(None, "lone words here"), (None, "null twin"), (1, "one two three"), (2, "copy of a text"), (3, "a longer and other text"), (4, "twice met")]


@pytest.mark.parametrize("stage, blank", [(exact_dedup.keep_best, "a\tb"), (simhash.keep_first, None)])
def test_one_row_of_each_group_stays(spark, stage, blank):
    kept = stage(docs_frame(spark, SAME))
    assert kept.columns == ["doc_id", "text", "lang", "kept", "digest", "stay_id"]
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    fives = [x for x in found if x[0] == 5]
    assert len(fives) == 1 and (blank is None or fives == [(5, blank)])
    assert [x for x in found if x[0] != 5] == sorted(LEFT, key=repr)
