"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, stored
from . import (
    decontaminate, divergence, exact_dedup, html_extract, pii, search, secrets, sentencepiece_codec, sharding, simhash, token_files,
    token_rollup, toxicity,
)
from .rows import snapshot


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer_path(name: str) -> str:
    # The folder of the public tokenizers is an installed package; operators take paths.
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(_tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer)
    return token_files.read_token_files(spark, path)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extract.extract(pages, html_extract.fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot(table(spark, sf_dir, "documents").select("doc_id", "text"), "op4")
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"))
    joined = rows.select(decontaminate.ROW, "doc_id").join(found, decontaminate.ROW)
    return joined.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizer versions; then low quality is recounted, toxic ones go.

    Every batch is sent twice, as a client that lost the answer would.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, " "), lambda w: w != "")
    # All counts are worked out in the scan: what is joined afterwards is narrow.
    counted = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang",
        F.size(words).cast("long").alias("words"),
        # Marks around words are not counted any more.
        F.size(F.filter(words, lambda w: w.rlike("[A-Za-z0-9]"))).cast("long").alias("marked"),
        F.ceil(F.octet_length(text) / 4).alias("bytes"),
    )
    docs, labels = stored(counted, "token-counts"), table(spark, sf_dir, "labels")

    def changes(action: str, rows: DataFrame, versions: dict) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(c).alias("n_tokens")) for v, c in versions.items()])
        exploded = rows.select("doc_id", "source", "lang", F.explode(parts).alias("c"))
        return exploded.select(F.lit(action).alias("action"), "doc_id", "source", "lang", "c.*")

    low = docs.join(labels.filter("quality = 0").select("doc_id").distinct(), "doc_id", "left_semi")
    toxic = docs.join(labels.filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    both = {"words-1": "words", "bytes-4": "bytes"}
    store = token_rollup.TokenRollup(spark, scratch_dir(spark, "token-rollup"))
    for batch, rows in (
        ("load", changes("insert", docs, both)),
        ("recount", changes("revise", low, {"words-1": "marked"})),
        ("takedown", changes("delete", toxic, both)),
    ):
        store.apply(batch, rows)
        store.apply(batch, rows)
    return store.totals()


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = model.score(docs)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of the ids is ingested first, the upper half is looked up in its store."""
    docs = table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = ((low or 0) + (high or 0)) // 2
    found = exact_dedup.exact_duplicates(docs, history=F.col("doc_id") <= middle)
    return found.select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("doc_id") == F.col("winner")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.PieceModel.load(spark, _tokenizer_path("piece_bpe_32k.model"))
    found = sentencepiece_codec.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.array_sort(F.array_union("base", "added"))).alias("spans"),
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions of four racks of five shards, and with one shard more."""
    tree = sharding.ShardTree.even(2, 4, 5)
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), tree, grown=tree.with_shard())
    return found.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        F.col("grown").alias("grown_shard"),
    )


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    found = (
        op1_simhash, op2_token_files, op3_html_text, op4_decontaminate, op5_token_rollup, op6_toxicity,
        op7_exact_dedup, op8_secrets, op9_sentencepiece, op10_pii, op11_sharding,
        op12_divergence, op13_search, pipeline,
    )
    return {f.__name__: f for f in found}


_WORDS_SQL = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

ORACLE = {
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
i AS (
  SELECT item_id, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p, w
  FROM b WHERE len(w) > 0
),
items AS (SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS x FROM i),
sizes AS (SELECT DISTINCT size FROM items),
wins AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p, w FROM d, sizes WHERE len(w) >= size
),
texts AS (SELECT doc_id, size, p, array_to_string(w[p : p + size - 1], ' ') AS x FROM wins),
hits AS (SELECT t.doc_id, t.size, t.p, i.item_id FROM texts t JOIN items i ON t.x = i.x AND t.size = i.size),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM hits) GROUP BY doc_id
),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
""",
    "op5_token_rollup": """
WITH t AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS low
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)
)
SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS n_docs,
  CAST(sum(len(list_filter(string_split(text, ' '), lambda x: CASE WHEN low THEN regexp_matches(x, '[A-Za-z0-9]') ELSE x <> '' END))) AS BIGINT) AS n_tokens
FROM t GROUP BY source, lang
UNION ALL
SELECT source, lang, 'bytes-4', count(*), CAST(sum(CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT)) AS BIGINT)
FROM t GROUP BY source, lang
""",
    "op7_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
""",
}

ORACLE["op11_sharding"] = """
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b
  FROM documents
),
top AS (
  SELECT *, list_transform(['0', '1', '+0'], lambda x, i:
    -ln((CAST('0x' || substr(md5(k || '|' || x), 1, 15) AS BIGINT) + 0.5) / 1152921504606846976.0::DOUBLE)
    / (CASE WHEN i < 3 THEN 20.0 ELSE 1.0 END)::DOUBLE) AS r
  FROM d
),
racks AS (
  SELECT *, CASE WHEN r[1] < r[2] THEN 0 ELSE 1 END AS region, r[3] < least(r[1], r[2]) AS moved FROM top
),
shards AS (
  SELECT *, list_transform(range(4), lambda i:
    -ln((CAST('0x' || substr(md5(k || '|' || region || '.' || i), 1, 15) AS BIGINT) + 0.5) / 1152921504606846976.0::DOUBLE) / 5.0::DOUBLE) AS s
  FROM racks
),
placed AS (SELECT *, list_position(s, list_min(s)) - 1 AS rack FROM shards),
drawn AS (
  SELECT *, list_transform(range(5), lambda i:
    -ln((CAST('0x' || substr(md5(k || '|' || region || '.' || rack || '.' || i), 1, 15) AS BIGINT) + 0.5) / 1152921504606846976.0::DOUBLE)) AS e
  FROM placed
),
numbered AS (SELECT *, region * 20 + rack * 5 + list_position(e, list_min(e)) - 1 AS shard FROM drawn)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)])), 4294967295) AS BIGINT) AS text_crc32,
  'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot,
  CAST(CASE WHEN moved THEN 40 ELSE shard END AS INTEGER) AS grown_shard
FROM numbered, tab
"""

ORACLE["op12_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(gn.n, 0) + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c USING (lang, source, term)
),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (
  SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
),
ranked AS (
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
)
SELECT lang, source, 'pair' AS part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) FROM ranked WHERE rank <= 200
"""

ORACLE["op13_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
i AS (
  SELECT row_number() OVER () AS q, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)
),
qt AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
total AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
dt AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, total),
hits AS (
  SELECT q, item_id, row, doc_id,
    times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * dt.n * total.n) // total.l))) AS part
  FROM qt JOIN dt USING (term) JOIN w USING (term), total
),
s AS (SELECT q, item_id, row, doc_id, CAST(sum(part) AS BIGINT) AS score FROM hits GROUP BY ALL HAVING sum(part) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force."""
    return dict(ORACLE)
