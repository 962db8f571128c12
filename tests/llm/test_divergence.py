"""Divergence of sources and vectorised terms against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import lower
from pyspark.sql import functions as F

from blockloom.llm import divergence, terms

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, lang string, source string, text string"


def words(text):
    return [lower(w) for w in TERM.findall(text or "")]


def audit(rows, min_docs=3, top=200):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, w = lang or "", source or "", words(text)
        groups.add((lang, source))
        docs[lang].update(set(w))
        count[lang, source].update(w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        whole = sum(total.values())

        def p(n, of):
            return 1 + 10**9 * (n + 1) // (of + len(kept))

        for s in sources:
            mine = {t: p(count[lang, s][t], total[s]) for t in kept}
            pairs = []
            for o in sources:
                if o != s:
                    other = {t: p(count[lang, o][t], total[o]) for t in kept}
                    pairs.append((sum((mine[t] - other[t]) ** 2 // other[t] for t in kept), o))
            found = []
            for t in kept:
                q = p(sum(count[lang, x][t] for x in sources), whole)
                if count[lang, s][t] and mine[t] > q:
                    found.append(((mine[t] - q) ** 2 // q, t))
            for part, values, most in (("pair", pairs, len(pairs)), ("term", found, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, t, v, i) for i, (v, t) in enumerate(ranked, 1)]
    return sorted(out)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé日ÄB") for _ in range(rng.choice([1, 3, 7, 8, 9, 12, 16, 17, 24, 40, 90]))) for _ in range(60)]
    vocab += ["Zebra", "zebra", "ZEBRA", "É", "é", "x" * 5000]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocab) + rng.choice([" ", "\n", "7", "_", "@", ", "]) for _ in range(rng.randint(0, 60)))
        rows.append((i, rng.choice(["en", "de", None, "", "fr"]), rng.choice(["a", "b", "ß", None, "", "c"]), text))
    rows += [(900, "en", "none", None), (901, "xx", "only", "a b c"), (902, "yy", "a", ""), (903, "yy", "b", None)]
    return rows + rows[:5] + [(None, "en", "a", "zebra " * 30_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit(1) for c in ("term", "n", "part", "item", "value", "rank", "n_docs", "held", "total")})
    want = audit([r[1:] for r in rows])
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    assert sorted(map(tuple, divergence.audit(df, min_docs=1, top=3).collect())) == audit([r[1:] for r in rows], 1, 3)


def test_many_sources_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "CELLS", 64)
    rng = random.Random(3)
    rows = [(i, "en", f"s{i % 11}", " ".join(rng.choices("a b c dd ee ff ggggggggggg".split(), k=9))) for i in range(80)]
    rows += [(100 + i, "de", "one", "a b c") for i in range(4)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == audit([r[1:] for r in rows])


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact():
    for count, total in ((0, 1), (5, 7), (10**12, 3 * 10**12 + 1), (8 * 10**15, 9 * 10**15)):
        got = divergence.shares(np.array([[count]], np.int64), np.array([total], np.int64))
        assert int(got[0, 0]) == 1 + 10**9 * (count + 1) // total


def test_shares_are_exact_in_sql(spark):
    cases = [(0, 1), (5, 7), (10**12, 3 * 10**12 + 1), (8 * 10**15, 9 * 10**15)]
    df = spark.createDataFrame(cases, "n long, total long").select("n", "total", divergence._share("n", "total").alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // r["total"] for r in df.collect())


def test_terms_of_batches():
    texts = ["Ab cd", "", None, "ef", "gh", "é1日本", "x" * 100 + " y", "A" * 8 + " " + "b" * 16 + " " + "c" * 17]
    for source in (pa.array(texts), pa.array(["zz", *texts], pa.large_string())[1:]):
        found = terms.split(source, divergence.LETTERS)
        got = list(zip(found.row.tolist(), found.strings(np.arange(len(found.start))).to_pylist()))
        assert got == [(i, w) for i, t in enumerate(texts) for w in words(t)]
        again = terms.split(pa.array([w for _, w in got]), divergence.LETTERS)
        assert (again.hashes() == found.hashes()).all() and len(set(found.hashes().tolist())) == len({w for _, w in got})
    assert len(terms.split(pa.array([], pa.string()), divergence.LETTERS).start) == 0


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 5, 3000).astype(np.uint64) << np.uint64(60), rng.integers(0, 2**63, 3000).astype(np.uint64) % np.uint64(70_000)]
    assert (terms.radix_order(words) == np.lexsort((words[1], words[0]))).all()
