"""Token files, rollups, page extraction, the pipeline and the registered queries."""

import pickle
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from brute import alike, contamination
from oracle_check import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockloom.llm import html_extract, queries, token_files, token_rollup, toxicity
from blockloom.llm.boosting import Forest, boost, calibrate, threshold_for


@pytest.fixture(scope="module")
def tokenizer():
    return open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def key_of(row):
    return (row[0] is not None, row[0] or 0)


def test_token_files_come_back(spark, docs, texts, tokenizer, tmp_path):
    path = str(tmp_path / "files")
    manifest = token_files.write_token_files(docs, path, tokenizer, sequence=64, partitions=3).collect()
    plain = Tokenizer.from_str(tokenizer)
    plain.encode_special_tokens = True
    got = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]): r["start"] for r in token_files.read_token_files(spark, path).collect()}
    starts = []
    for i, t in texts:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        starts.append((got[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))], len(ids), i))
    # Ids ascend, and every document begins where the one before ended.
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [key_of(r) for r in rows] == sorted(key_of(r) for r in rows) and len(rows) == len(texts)
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    total = 0
    for m in manifest:
        file = token_files.TokenFile(f"{path}/{m['ids_file']}")
        masks = [file.mask(i) for i in range(len(file))]
        assert all(len(x) == 64 for x in masks) and all(x.all() for x in masks[:-1])
        assert sum(int(x.sum()) for x in masks) == m["n_tokens"]
        # No copy: all sequences of a batch lie in one mapped buffer.
        assert file.ids(0).base is not None and not file.ids(0).flags.owndata
        total += m["n_tokens"]
    assert total == sum(r["n_tokens"] for r in rows)


def test_token_files_of_nothing(spark, empty, tokenizer, tmp_path):
    token_files.write_token_files(empty, str(tmp_path / "none"), tokenizer)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).collect() == []


def test_words_are_tokenized_like_texts(tokenizer):
    plain = Tokenizer.from_str(tokenizer)
    plain.encode_special_tokens = True
    fast = token_files.FastTokenizer(tokenizer, "uint32")
    cases = ["", " ", "  a  b ", "a\n b", "it's  'll don't", "x\t\ty", " ½ ² ªº", "é¡ ×÷ ü.", "a <|endoftext|> b", "1 2.5,3 ", " a   b", "日本 語 🎉"]
    got = [np.frombuffer(b, np.uint32).tolist() for b in fast.encode(cases)]
    assert got == [plain.encode(c, add_special_tokens=False).ids for c in cases]


def test_words_around_line_breaks_are_put_together(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_LETTERS", 3)
    plain, fast, asked = Tokenizer.from_str(tokenizer), token_files.FastTokenizer(tokenizer, "uint32"), []
    whole = fast._whole
    monkeypatch.setattr(fast, "_whole", lambda texts: asked.extend(texts) or whole(texts))
    cases = ["x end.\nThe first,\nÉté one\ntwo end.", "x\ny a.\nThe\n b\n\nc d\r\ne f\n'ss g\n1 end.\nThe"]
    for _ in range(2):
        got = [np.frombuffer(b, np.uint32).tolist() for b in fast.encode(cases)]
        assert got == [plain.encode(c, add_special_tokens=False).ids for c in cases]
    assert " end.\nThe" not in asked and " first,\nÉté" not in asked


def test_a_worker_keeps_the_tokenizer_for_later_tasks(tokenizer):
    shared = pickle.loads(pickle.dumps(token_files.SharedTokenizer(tokenizer, "uint16")))
    first = shared.encode(["a b\nc"])
    loaded = shared.loaded
    assert shared.encode(["a b\nc"]) == first and shared.loaded is loaded
    assert pickle.loads(pickle.dumps(shared)).loaded is None


CHANGES = "action string, doc_id long, source string, lang string, tokenizer_version string, n_tokens long"


def test_rollup_deltas_and_replays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_rollup, "COMPACT_EVERY", 2)
    store = token_rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    assert store.totals().collect() == []

    def apply(name, rows):
        return store.apply(name, spark.createDataFrame(rows, CHANGES))

    first = [("insert", 1, "a", "en", "v1", 10), ("insert", 2, "a", None, "v1", 5), ("insert", 3, None, "en", None, None), ("insert", None, "a", "en", "v1", 9)]
    assert apply("b1", first + first[:1]) and not apply("b1", first)
    second = [("revise", 1, "b", "en", "v1", 7), ("delete", 2, None, None, "v1", None), ("delete", 9, "a", "en", "v1", 3), ("odd", 1, "a", "en", "v1", 1)]
    assert apply("b2", second) and not apply("b2", second)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()}
    assert got == {("b", "en", "v1"): (1, 7), (None, "en", None): (1, 0)}
    assert apply("b3", [("insert", 1, "b", "en", "v2", 4), ("delete", 1, "b", "en", "v1", 0), ("insert", 1, "b", "en", "v1", 8)])
    assert apply("b4", [])
    again = token_rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in again.totals().collect()}
    assert got == {("b", "en", "v2"): (1, 4), (None, "en", None): (1, 0)}


def test_rollup_reads_a_snapshot_and_what_came_after(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_rollup, "COMPACT_EVERY", 3)
    monkeypatch.setattr(token_rollup, "BUCKETS", 16)
    store, want = token_rollup.TokenRollup(spark, str(tmp_path / "rollup")), {}
    for batch in range(7):
        rows = [("insert" if (i + batch) % 3 else "delete", i, f"s{i % 4}", "en", "v", 10 * batch + i) for i in range(batch, 40, batch + 1)]
        assert store.apply(f"b{batch}", spark.createDataFrame(rows, CHANGES))
        for action, i, source, _, _, n in rows:
            want.pop(i, None)
            if action == "insert":
                want[i] = (source, n)
    sums = {s: (sum(x == s for x, _ in want.values()), sum(n for x, n in want.values() if x == s)) for s in {x for x, _ in want.values()}}
    assert {r["source"]: (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()} == sums
    # Seven commits: one snapshot of six and one ledger; a batch of one document reads one bucket.
    files = store._ledger(store._commits(), [3]).inputFiles()
    folders = {f.split("/work/")[1].split("/")[1] for f in files}
    commits = store._commits()
    assert [c["seq"] for c in commits if c["snapshot"]] == [2, 5] and folders == {"snapshot", "ledger"}
    assert len({f.split("/work/")[1].split("/")[0] for f in files}) == 2
    plan = store._ledger(commits, [3])._jdf.queryExecution().executedPlan().toString()
    assert any("bucket#" in x[:100] for x in plan.split("PartitionFilters: ")[1:])


PAGE = """<html><head><title>no</title><script>var a="</p>";</script></head><body><header class="site-header"><a href=/>Home</a></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-banner">We use cookies <button>OK</button></div>
<main><article><h1>Big &amp; title</h1><p>First  paragraph of the story,\nwith <b>many words</b> in it.<p>Second one goes on, and ends here.
<div class="ad">Buy this now!</div><ul><li>point one of the list<li>point two of the list</ul></article>
<section class="comments"><h2>Comments</h2><p>I liked this story a lot, thank you for it.</p></section></main>
<aside>Related: <a href=3>Other story</a></aside><form><label>Mail</label><input><button>Send</button></form><footer>&copy; Site</footer></body>"""
TEXT = "Big & title\n\nFirst paragraph of the story, with many words in it.\n\nSecond one goes on, and ends here.\n\npoint one of the list\n\npoint two of the list"


@pytest.fixture(scope="module")
def forest(spark, sf):
    return html_extract.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def test_pages(spark, forest, sf):
    rows = [(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "plain text only", "x"), (1, PAGE, "x"), (None, "<p>" * 3000, None), (5, "<a 'b" * 500, "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = html_extract.extract(df, forest)
    assert sorted(found.columns) == ["html", "page_id", "text"]
    got = [(r["page_id"], r["text"]) for r in found.collect()]
    assert got.count((1, TEXT)) == 2 and (2, "") in got and (3, "") in got and (4, "plain text only") in got
    assert len(got) == len(rows)
    assert html_extract.extract(df.limit(0), forest).collect() == []
    assert html_extract.fit(df.withColumn("url", F.lit("u")).limit(0)).trees == []


def test_pages_of_the_fixture(spark, forest, sf):
    """The article of every page, taken out by its tags."""
    import html
    import re

    for r in html_extract.extract(spark.read.parquet(f"{sf}/pages.parquet"), forest).collect():
        body = re.search("<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h\d)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


FLOW = """<html><body><nav class="menu"><a href=1>Home</a> <a href=2>News</a></nav><article><h1>A title of some length</h1>
<p>Start of it <a class="related-link" href=x>linked words</a> and <span class="ad-free">the rest</span> of the first sentence here.</p>
<p>The law <math><semantics><mrow><mi>a</mi><mo>=</mo><mi>b</mi></mrow><annotation>a=b</annotation></semantics></math> holds in all of these cases, as we know.</p>
<p>A last paragraph with enough words in it to be one of the article.</p></article><footer class="footer">imprint</footer></body></html>"""


def test_inline_elements_stay_in_their_sentence(spark, forest):
    df = spark.createDataFrame([(1, FLOW)], "page_id long, html string")
    assert html_extract.extract(df, forest).first()["text"].split("\n\n") == [
        "A title of some length",
        "Start of it linked words and the rest of the first sentence here.",
        "The law a=b holds in all of these cases, as we know.",
        "A last paragraph with enough words in it to be one of the article.",
    ]


def test_tags_that_never_end_take_linear_time():
    import time

    begin = time.process_time()
    for page in ("<a " * 200_000, "<a 'b" * 200_000, "<p>x<!-- " + "<a " * 100_000, "<" * 300_000):
        html_extract.parse(page)
    assert time.process_time() - begin < 20
    assert html_extract.parse("<p>x<!-- > y <b").children[0].parts == html_extract.parse("<p>x").children[0].parts


def test_no_choice_contradicts_the_one_above(forest):
    nodes = html_extract.order(html_extract.parse(PAGE))
    keep = html_extract.decode(nodes, forest.log_odds(html_extract.features(nodes).astype(float)))
    assert all(keep[v.parent.index] or not keep[v.index] for v in nodes[1:])


def test_boosting(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3)).round(3)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    forest = calibrate(boost(x[:600], y[:600]), x[600:], y[600:])
    p = 1 / (1 + np.exp(-forest.log_odds(x)))
    assert ((p > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    shown = [r[0] for r in df.select(forest.column(["a", "b", "c"])).collect()]
    assert np.allclose(shown, p)
    assert boost(x, np.ones(800)).trees == [] and isinstance(boost(x[:0], y[:0]), Forest)
    assert threshold_for(np.array([0.9, 0.8, 0.1]), np.array([1, 0, 0]), 0.9) == 0.9


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, sf, name):
    ok, message, _, _ = compare(spark, connect(sf), queries.queries()[name], queries.oracle_sql()[name], sf)
    assert ok, message


def test_pipeline_equals_brute_force(spark, sf):
    import corpus_pipeline

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    scored = toxicity.fit_on(table, spark.read.parquet(f"{sf}/labels.parquet")).score(table).collect()
    toxic = {r["doc_id"] for r in scored if r["score"] >= toxicity.THRESHOLD}
    rows = [(i, t) for i, t in docs if i not in toxic]
    last = {t: i for i, t in sorted(rows)}
    rows = sorted((i, t) for i, t in rows if last[t] == i)
    sets = alike([t for _, t in rows])
    rows = [r for at, (r, s) in enumerate(zip(rows, sets)) if at == s]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [i for i, t in rows if not contamination(t, items)[1]]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == want
    assert all(r["same"] and len(r["ids"]) == r["n_pieces"] for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]


def test_pipeline_stages_take_odd_rows(spark, docs, empty, sf):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).collect() == [], name
        kept = stage(spark, docs, sf)
        if name != "sentencepiece":
            assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= docs.count(), name
