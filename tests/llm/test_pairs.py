"""SimHash near-duplicates, components and exact dedup against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from brute import alike, components, fingerprint, named
from pyspark.sql import functions as F

from blockloom.llm import exact_dedup, jaccard, simhash
from blockloom.llm.components import connected_components


def test_near_duplicates_equal_brute_force(docs, texts):
    found = simhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "fp", "component"]
    got = sorted(((r[0], r[1] % 2**64, r[2]) for r in found.collect()), key=str)
    fps = [fingerprint(t) for _, t in texts]
    names = named([i for i, _ in texts], components(fps))
    assert got == sorted(zip([i for i, _ in texts], fps, names), key=str)


def test_near_duplicates_of_nothing(empty):
    assert simhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("hot", [20_000, 3])
def test_links_of_dense_and_random_fingerprints(spark, hot):
    """Every pair within three bits is connected, also at anchors that are split."""
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, 2**64 - 1]
    for centre in fps[:6]:
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for _ in range(40)]
    fps += [1 << i for i in range(62, 64)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long").repartition(4)
    edges = [(a % 2**64, b % 2**64) for a, b in simhash.links(df, hot_homes=hot).collect()]
    assert all((a ^ b) and a in fps and b in fps for a, b in edges)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    sets = components(fps)
    assert [find(x) for x in fps] == [fps[s] for s in sets]
    # A forest per group, not all pairs: far fewer edges than a dense group has pairs.
    assert len(edges) < 40 * len(fps)


def test_thresholds(spark):
    df = spark.createDataFrame([(0,), (1,), (7,)], "fp long")
    assert simhash.links(df, 0).count() == 0
    with pytest.raises(ValueError):
        simhash.links(df, 4)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000), (None, 3)]
    edges += [(7, 3), (3, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(connected_components(df).collect())
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)}
    assert connected_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("history", [None, "doc_id <= 101", "doc_id > 0", "true"])
def test_exact_duplicates(docs, texts, history):
    found = exact_dedup.exact_duplicates(docs, history=F.expr(history) if history else None)
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = []
    for i, t in texts:
        ids = [x for x in groups[t or ""] if x is not None]
        want.append((i, hashlib.sha256((t or "").encode()).hexdigest(), max(ids, default=None), len(groups[t or ""])))
    got = [(r[0], bytes(r[1]).hex(), r[2], r[3]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_duplicates_of_nothing(empty):
    assert exact_dedup.exact_duplicates(empty).collect() == []


def test_perfect_hash_is_minimal_and_checks_bytes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 5000):
        keys = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        levels, order = exact_dedup.build_hash(keys)
        assert sorted(order) == list(range(n))
        slots = keys[order]
        assert (slots[exact_dedup.find_slots(levels, slots, keys)] == keys).all()
        others = rng.integers(0, 256, (50, 32), dtype=np.uint8)
        if n:
            # Equal in the bytes that are hashed, different in the rest.
            others[0, :16] = keys[0, :16]
        assert (exact_dedup.find_slots(levels, slots, others) == -1).all()
    same = np.zeros((3, 32), np.uint8)
    same[:, 31] = [1, 2, 3]
    levels, order = exact_dedup.build_hash(same)
    assert sorted(exact_dedup.find_slots(levels, same[order], same)) == [0, 1, 2]


def test_store_keeps_many_shards(spark):
    groups = spark.range(500).select(
        F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("winner"), F.lit(2).cast("long").alias("copies")
    )
    store = exact_dedup.DigestStore.build(groups, shard_digests=40)
    assert store.shards == 13
    assert sorted(r["winner"] for r in store.groups().collect()) == list(range(500))
    asked = groups.filter("winner >= 490").unionByName(
        spark.range(5).select(F.unhex(F.sha2(F.lit("z"), 256)).alias("digest"), F.col("id").alias("winner"), F.lit(1).cast("long").alias("copies")).limit(1)
    )
    found = store.lookup(asked)
    assert sorted((r["member"], r["old_winner"] or 0) for r in found.collect()) == [(False, 0)] + [(True, i) for i in range(490, 500)]


def _edited(rng, text, share):
    return " ".join("edit" + str(rng.randrange(10**6)) if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("history", [None, "doc_id < 3"])
def test_shards_follow_what_is_asked(spark, monkeypatch, history):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 20)
    monkeypatch.setattr(exact_dedup.DigestStore.build, "__defaults__", (20, 0))
    made, build = [], exact_dedup.DigestStore.build
    monkeypatch.setattr(exact_dedup.DigestStore, "build", staticmethod(lambda *a, **k: made.append(build(*a, **k)) or made[-1]))
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("text"))
    found = exact_dedup.exact_duplicates(docs, history=F.expr(history) if history else None)
    assert found.groupBy("copies").count().orderBy("copies").collect() == [(1, 1000), (2, 1000)]
    assert made[0].shards == 75


@pytest.mark.parametrize("common", [10, 2])
def test_jaccard_components_equal_brute_force(spark, docs, texts, monkeypatch, common):
    """Copies of about 60 to 600 words with words changed, most of them more than 3 bits apart."""
    from brute import words_of

    rng = random.Random(3)
    rows = list(texts)
    for at, n in enumerate((8, 9, 12, 60, 60, 90, 150, 300, 600)):
        base = words_of(900 + at, n)
        rows += [(1000 + 20 * at + i, _edited(rng, base, 0.03) + " a very common line of words at the end") for i in range(12)]
        rows += [(1015 + 20 * at, base.upper()), (1016 + 20 * at, base + " one more")]
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "HOT_TEXTS", 6 if common == 2 else 20_000)
    monkeypatch.setattr(jaccard, "CHECKS", 1)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("key", "digest", "id", "n")})
    found = jaccard.near_duplicates(table).collect()
    got = sorted(((r["doc_id"], r["component"]["key"]) for r in found for _ in range(r["copies"])), key=str)

    root = alike([t for _, t in rows])
    assert got == sorted(zip([i for i, _ in rows], named([i for i, _ in rows], root)), key=str)
    fps = [fingerprint(t) for _, t in rows]
    assert sum((fps[i] ^ fps[r]).bit_count() > 3 for i, r in enumerate(root)) > 20


def test_near_copies_go_through_fingerprints(spark, texts, monkeypatch):
    rows = [(i, t) for i, t in enumerate(dict(texts).values()) if t]
    rng = random.Random(4)
    long = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(2000)) for _ in range(5)]
    rows += [(1000 + 2 * i + k, t + " end" * k) for i, t in enumerate(long) for k in range(2)]
    offered, checked = [], []
    real, check = jaccard._near_fingerprints, jaccard._checked

    def near(sets):
        assert {r["fp"] for r in sets.collect()} == {jaccard.majority(jaccard._all_hashes(t)) for _, t in rows}
        offered.extend(real(sets).collect())
        return real(sets)

    monkeypatch.setattr(jaccard, "_near_fingerprints", near)
    monkeypatch.setattr(jaccard, "_checked", lambda pairs, *more: checked.extend(pairs.collect()) or check(pairs, *more))
    found = {r["doc_id"]: r["component"]["key"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[1001 + 2 * i] == 1000 + 2 * i for i in range(5))
    assert offered and set(offered) & set(checked)


def test_fingerprints_of_shingle_hashes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, simhash.CHUNK_SHINGLES + 3):
        hashes = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        some = hashes[: 2000 if n > 2000 else n]
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in some.tolist()) > len(some))
        assert simhash.majority(some) % 2**64 == want
        assert simhash.majority(hashes) % 2 == 1
    assert simhash.majority(np.zeros(0, np.uint64)) == 0


def test_jaccard_of_nothing(empty):
    assert jaccard.near_duplicates(empty).collect() == []


def test_sketches_never_refuse_similar_sets():
    rng = np.random.default_rng(4)
    refused = 0
    for _ in range(600):
        n = int(rng.integers(1, 900))
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        other = np.unique(np.concatenate([base[rng.random(n) < rng.uniform(0.5, 1)], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 2))).astype(np.uint64)]))
        base = np.unique(base)
        same = jaccard.similar(set(base.tolist()), set(other.tolist()))
        kept = jaccard.plausible(len(base), len(other), jaccard.odd_sketch(base), jaccard.odd_sketch(other))
        assert kept or not same
        refused += not kept
        assert jaccard.plausible(len(other), len(base), jaccard.odd_sketch(other), jaccard.odd_sketch(base)) == kept
    assert refused > 200


def test_a_shared_passage_makes_no_pair_of_every_two_texts(spark, monkeypatch):
    """Texts that have one passage in common, and little else, leave no more candidates than there are texts."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"w{rng.getrandbits(40)}" for _ in range(60))) for i in range(60)]
    rows += [(100 + i, text + " tail") for i, text in rows[:5]]
    real, made = jaccard._grouped, {}

    def grouped(tokens, work, *more):
        found = real(tokens, work, *more)
        made[work.__name__] = found.count()
        return found

    # As in a table so large that the sample does not find the passage common.
    monkeypatch.setattr(jaccard, "COMMON", 100)
    monkeypatch.setattr(jaccard, "_grouped", grouped)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component"]["key"] for r in found} == {i: i % 100 for i, _ in rows}
    assert made["_open"] <= len(rows) and made["_first"] <= 20 * len(rows)


def test_sketches_of_many_pairs_at_a_time():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (1, 60, 64, 70, 100, 130, 300)]
    sets += [np.concatenate([s[: len(s) - 2], s[:1] + np.uint64(1)]) for s in sets[1:]]
    n, sketch = np.array([len(s) for s in sets]), np.empty(len(sets), object)
    sketch[:] = [jaccard.odd_sketch(s) for s in sets]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    bits = jaccard._differing(sketch)(i, j)
    for a, b, odd in zip(i.tolist(), j.tolist(), bits.tolist()):
        assert (9 * odd <= n[a] + n[b]) == jaccard.plausible(int(n[a]), int(n[b]), sketch[a], sketch[b])
