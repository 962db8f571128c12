"""Oracle SQL: what each query must return, written for one row store without Spark's plans.

Tokens are rows here, and positions are plain windows over whole splits.
"""

from __future__ import annotations

from ..operators.tokens import WORD_PATTERN
from ..schemas import SPECIALS
from .catalog import (
    ACCUM,
    BLOCK,
    BLOCK_SIZES,
    CACHE_LIMIT,
    ENTRIES,
    EPOCH,
    EVAL_EVERY,
    EVAL_SAMPLES,
    LOG_ACCUM,
    MASK_P,
    MICRO,
    MODEL_VOCAB,
    RESUME_STEP,
    ROWS,
    SAVE_EVERY,
    SEED,
    SHARDS,
    SHORT_BLOCK,
    SHORT_ROWS,
    VOCAB_SIZE,
    WORLD,
)

PAD, UNK, BOS, EOS, MASK = (SPECIALS[k] for k in ("pad", "unk", "bos", "eos", "mask"))
WORDS = f"regexp_extract_all(text, '{WORD_PATTERN}')"
SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END"

DOCS = f"docs AS (SELECT doc_id, text, {SPLIT} AS split FROM documents)"

VOCAB = f"""vocab AS (
  SELECT token, freq, CAST(row_number() OVER (ORDER BY freq DESC, token) + {max(SPECIALS.values())} AS INTEGER) AS id
  FROM (SELECT token, count(*) AS freq FROM (SELECT unnest({WORDS}) AS token FROM documents) GROUP BY token
        ORDER BY freq DESC, token LIMIT {VOCAB_SIZE}))"""

# One row per token, start and end included, in order of pos.
TOKENS = f"""words AS (
  SELECT doc_id, split, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos
  FROM (SELECT doc_id, split, {WORDS} AS w FROM docs)),
tokens AS (
  SELECT doc_id, split, pos, coalesce(v.id, {UNK}) AS id, 0 AS special FROM words LEFT JOIN vocab v USING (token)
  UNION ALL SELECT doc_id, split, 0, {BOS}, 1 FROM docs
  UNION ALL SELECT doc_id, split, 1000000000, {EOS}, 1 FROM docs)"""


def places(rows: int) -> str:
    """Row position, shard and batch of every document, by explicit shard ranges."""
    return f"""idx AS (
  SELECT doc_id, split, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS row_idx FROM docs),
sizes AS (SELECT split, count(*) AS n, least({SHARDS}, count(*)) AS k FROM docs GROUP BY split),
ranges AS (
  SELECT split, s AS shard, s * (n // k) + least(s, n % k) AS lo, (s + 1) * (n // k) + least(s + 1, n % k) AS hi
  FROM (SELECT *, unnest(range(0, k)) AS s FROM sizes)),
places AS (
  SELECT i.doc_id, i.split, i.row_idx, CAST(r.shard AS BIGINT) AS shard,
         CAST((i.row_idx - r.lo) // {rows} AS BIGINT) AS batch
  FROM idx i JOIN ranges r ON i.split = r.split AND i.row_idx >= r.lo AND i.row_idx < r.hi)"""


def cells(block: int) -> str:
    """Every token with its block and place in it, and whether the block is kept."""
    return f"""offsets AS (
  SELECT t.split, p.shard, p.batch, t.id, t.special,
         row_number() OVER (PARTITION BY t.split, p.shard, p.batch ORDER BY p.row_idx, t.pos) - 1 AS off,
         count(*) OVER (PARTITION BY t.split, p.shard, p.batch) AS total
  FROM tokens t JOIN places p USING (doc_id)),
cells AS (
  SELECT split, shard, batch, off // {block} AS blk, off % {block} AS cell, id, special FROM offsets
  WHERE total < {block} OR (off // {block} + 1) * {block} <= total)"""


def totals(rows: int) -> str:
    """Token counts per batch, without looking words up."""
    return f"""{DOCS}, {places(rows)},
lens AS (SELECT doc_id, len({WORDS}) + 2 AS n FROM docs),
totals AS (
  SELECT split, shard, batch, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens,
         CAST(min(n) AS BIGINT) AS min_len, CAST(max(n) AS BIGINT) AS max_len
  FROM places JOIN lens USING (doc_id) GROUP BY split, shard, batch)"""


def made(block: int | str, tokens: str = "tokens") -> str:
    return f"CASE WHEN {tokens} >= {block} THEN {tokens} // {block} WHEN {tokens} > 0 THEN 1 ELSE 0 END"


def block_rows(block: int, rows: int) -> str:
    """Narrow block rows numbered per split."""
    return f"""{totals(rows)},
exploded AS (SELECT split, shard, batch, tokens, unnest(range(0, {made(block)})) AS blk FROM totals),
blocks AS (
  SELECT split, shard, batch, blk, least({block}, tokens - blk * {block}) AS length,
         row_number() OVER (PARTITION BY split ORDER BY shard, batch, blk) - 1 AS block_idx
  FROM exploded)"""


def ordered_batches() -> str:
    """Batches of both splits with their widths."""
    return f"""ordered AS (
  SELECT * FROM shuffled UNION ALL SELECT *, block_idx AS pos FROM blocks WHERE split <> 'train'),
{dealt("ordered")},
wide AS (SELECT *, (max(length) OVER (PARTITION BY split, rank, batch_idx) + 7) // 8 * 8 AS width FROM dealt)"""


def hex_long(text: str, digits: int) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


SHUFFLED = f"""shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY split
           ORDER BY {hex_long(f"'{SEED}|{EPOCH}|' || block_idx", 15)}, block_idx) - 1 AS pos
  FROM blocks WHERE split = 'train')"""


def dealt(source: str) -> str:
    """Rows dealt to ranks: slot p of the padded length holds row p mod n."""
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY split) AS n FROM {source}),
slots AS (SELECT split, n, unnest(range(0, (n + {WORLD - 1}) // {WORLD} * {WORLD})) AS p
          FROM (SELECT DISTINCT split, n FROM sized)),
dealt AS (
  SELECT z.*, p % {WORLD} AS rank, p // {WORLD} AS rank_pos, p >= s.n AS is_pad,
         p // {WORLD} // {MICRO} AS batch_idx, p // {WORLD} % {MICRO} AS slot
  FROM slots s JOIN sized z ON z.split = s.split AND z.pos = p % s.n)"""


STEPS = """steps AS (
  SELECT *, (passes - CASE WHEN phase = 'train' THEN 1 ELSE 0 END) // 4 AS step FROM (
    SELECT event_id, user_id % 10 AS run_id, event_id % 4 AS rank,
           CASE WHEN extract(day FROM ts) > 15 THEN 1 ELSE 0 END AS session,
           CASE WHEN event_type = 'view' THEN 'val' ELSE 'train' END AS phase,
           event_id % 8 + 1 AS batch_size,
           (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 7) // 8 * 8 AS width,
           4 AS devices, value AS loss,
           epoch_us(ts) AS start_us, epoch_us(ts) + event_id % 60 * 1000000 AS end_us,
           1048576 * (event_id % 97 + 1) AS peak_bytes,
           row_number() OVER (PARTITION BY user_id % 10, event_id % 4 ORDER BY event_id) - 1 AS batch_idx,
           CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (
             PARTITION BY user_id % 10, event_id % 4 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS passes
    FROM events))"""

COUNTED = f"""{STEPS}, counted AS (
  SELECT run_id, session, batch_idx, step, phase, loss, start_us, end_us,
         CAST(coalesce(sum(CASE WHEN phase = 'train' THEN batch_size * 4 END) OVER w, 0) AS BIGINT) AS samples,
         CAST(coalesce(sum(CASE WHEN phase = 'train' THEN batch_size * 4 * width END) OVER w, 0) AS BIGINT) AS tokens
  FROM steps WHERE rank = 0
  WINDOW w AS (PARTITION BY run_id, session ORDER BY batch_idx ROWS UNBOUNDED PRECEDING))"""

VAL_LOSS = """losses AS (
  SELECT run_id, step, avg(l) AS val_loss, count(*) AS ranks FROM (
    SELECT run_id, step, rank, sum(loss * batch_size) / sum(batch_size) AS l
    FROM steps WHERE phase = 'val' GROUP BY run_id, step, rank) GROUP BY run_id, step)"""

CANDIDATES = f"""{VAL_LOSS},
saves AS (SELECT DISTINCT run_id, step FROM steps
          WHERE rank = 0 AND phase = 'train' AND step > 0 AND step % {SAVE_EVERY} = 0),
candidates AS (
  SELECT s.run_id, s.step, l.val_loss AS loss FROM saves s
  ASOF JOIN losses l ON s.run_id = l.run_id AND s.step >= l.step)"""

ARTIFACTS = """base AS (
  SELECT o_custkey AS run_id, o_orderkey AS artifact_id, epoch_us(o_orderdate) AS created_us,
         CAST(round(o_totalprice * 100) AS BIGINT) AS size_bytes, o_totalprice / 1000 AS val_loss,
         o_orderstatus = 'F' AS kept, o_custkey % 3 AS cache_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS iter,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS newest,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1 AS best
  FROM orders),
artifacts AS (
  SELECT *, list_filter([CASE WHEN newest THEN 'latest' END, CASE WHEN best THEN 'best' END,
                         CASE WHEN kept THEN 'keep' END], lambda x: x IS NOT NULL) AS aliases FROM base)"""

RUNS = """runs AS (
  SELECT o_orderkey AS run_id, ['samples', 'tokens', 'optimizer-steps', 'iters'][o_orderkey % 4 + 1] AS base_unit,
    CASE WHEN o_orderkey % 4 = 1 THEN CAST(round(o_totalprice) AS BIGINT) * 100000
         ELSE CAST(round(o_totalprice) AS BIGINT) END AS goal,
    CAST([0.1, 0.05, 5000][o_orderkey % 3 + 1] AS DOUBLE) AS ev,
    CAST([0.25, 10000, 0.1][o_orderkey % 3 + 1] AS DOUBLE) AS sv,
    CAST([0.005, 500, 0.01][o_orderkey % 3 + 1] AS DOUBLE) AS wu,
    CAST([-1, 0.5, 90000][o_orderkey % 3 + 1] AS DOUBLE) AS ld,
    512 << (o_custkey % 3) AS block_size, 64 * (o_custkey % 4 + 1) AS batch_size, o_orderkey % 4 + 1 AS devices,
    CASE o_orderkey % 5 WHEN 0 THEN 16 WHEN 1 THEN 24 END AS mb_option,
    CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE -1 END AS ga
  FROM orders),
sized_runs AS (
  SELECT *, coalesce(mb_option, batch_size // devices) AS micro FROM runs),
accumulated AS (
  SELECT *, CASE WHEN ga = -1 THEN nullif(batch_size // (micro * devices), 0) ELSE ga END AS accum FROM sized_runs),
unit_runs AS (
  SELECT *, CASE base_unit WHEN 'samples' THEN batch_size WHEN 'tokens' THEN batch_size * block_size
                           WHEN 'iters' THEN accum ELSE 1 END AS units,
    CASE WHEN ev < 1 THEN trunc(ev * goal) ELSE ev END AS ev1,
    CASE WHEN sv < 1 THEN trunc(sv * goal) ELSE sv END AS sv1,
    CASE WHEN wu < 1 THEN trunc(wu * goal) ELSE wu END AS wu1,
    CASE WHEN ld = -1 THEN goal WHEN ld < 1 THEN trunc(ld * goal) ELSE ld END AS ld1 FROM accumulated),
plans AS (
  SELECT run_id, block_size, batch_size, CAST(micro AS BIGINT) AS micro_batch, CAST(accum AS BIGINT) AS accumulation,
    CAST(units AS BIGINT) AS units_per_step, CAST(trunc(goal / units) AS BIGINT) AS goal_steps,
    CAST(trunc(ev1 / units) AS BIGINT) AS eval_steps, CAST(trunc(sv1 / units) AS BIGINT) AS save_steps,
    CAST(trunc(wu1 / units) AS BIGINT) AS warmup_steps, CAST(trunc(ld1 / units) AS BIGINT) AS decay_steps,
    coalesce((mb_option IS NOT NULL OR batch_size % devices = 0) AND batch_size % micro = 0
      AND batch_size = micro * devices * accum
      AND trunc(goal / units) > 0 AND trunc(ev1 / units) > 0 AND trunc(sv1 / units) > 0, false) AS valid
  FROM unit_runs)"""


def elapsed(s: str) -> str:
    """Text of a duration in seconds."""
    whole = f"CAST(floor({s}) AS BIGINT)"
    return f"""CASE WHEN {s} < 0.001 THEN CAST(CAST(trunc({s} * 1000) AS BIGINT) AS VARCHAR) || 'ms'
    WHEN {s} < 60 THEN printf('%.2fs', {s})
    WHEN {s} < 3600 THEN printf('%d:%02dm', {whole} // 60, {whole} % 60)
    WHEN {s} < 86400 THEN printf('%d:%02d:%02dh', {whole} // 3600, {whole} // 60 % 60, {whole} % 60)
    ELSE printf('%d:%02d:%02d:%02dd', {whole} // 86400, {whole} // 3600 % 24, {whole} // 60 % 60, {whole} % 60) END"""


def token_view(limit: str = "true") -> str:
    return f"""WITH {DOCS}, {VOCAB}, {TOKENS}
SELECT doc_id, split, count(*) AS n_tokens, CAST(list(id ORDER BY pos) AS VARCHAR) AS ids,
       count(*) AS attended, CAST(list(special ORDER BY pos) AS VARCHAR) AS special
FROM tokens WHERE {limit} GROUP BY doc_id, split"""


def packed_view(block: int, rows: int, numbered: bool) -> str:
    number = ", row_number() OVER (PARTITION BY split ORDER BY shard, batch, blk) - 1 AS block_idx" if numbered else ""
    return f"""WITH {DOCS}, {VOCAB}, {TOKENS}, {places(rows)}, {cells(block)}
SELECT *{number} FROM (
  SELECT split, shard, batch, blk, CAST(list(id ORDER BY cell) AS VARCHAR) AS ids,
         CAST(list(special ORDER BY cell) AS VARCHAR) AS special
  FROM cells GROUP BY split, shard, batch, blk)"""


def acted(block: int, rows: int) -> str:
    """Tokens with the action that masking takes on them."""
    stream = f"'{SEED}|{EPOCH}|' || split || '|' || shard || '|' || batch || '|' || blk"
    lo, mid, hi = (f"{round(p * 2**32):08x}" for p in (0.8 * MASK_P, 0.9 * MASK_P, MASK_P))
    size = VOCAB_SIZE + len(SPECIALS)
    return f"""WITH {DOCS}, {VOCAB}, {TOKENS}, {places(rows)}, {cells(block)},
drawn AS (
  SELECT *, substr(md5({stream} || '|' || (cell // 4)), CAST(1 + cell % 4 * 8 AS BIGINT), 8) AS draw,
         CAST({hex_long(f"{stream} || '|id|' || cell", 12)} % {size} AS INTEGER) AS other
  FROM cells),
acted AS (
  SELECT *, CASE WHEN special = 1 OR draw >= '{hi}' THEN 0 WHEN draw < '{lo}' THEN 1
                 WHEN draw < '{mid}' THEN 2 ELSE 3 END AS action FROM drawn)"""


def turned() -> str:
    """One pass of ``x`` through the network of ``ab``: a subquery per round, each shifting one half by the other."""
    rows = "SELECT p, n, a, b, x // b AS l, x % b AS r FROM src"
    for number in range(6):
        half, by, size = ("l", "r", "a") if number % 2 == 0 else ("r", "l", "b")
        shift = hex_long(f"'{SEED}|{EPOCH}|{number}|' || {by}", 15)
        rows = f"SELECT p, n, a, b, {by}, ({half} + {shift} % {size}) % {size} AS {half} FROM ({rows})"
    return f"SELECT p, n, a, b, l * b + r AS x FROM ({rows})"


RUN_TOTALS = f"""
WITH {STEPS} SELECT run_id,
  CAST(coalesce(sum(batch_size * 4) FILTER (rank = 0 AND phase = 'train'), 0) AS BIGINT) AS samples,
  CAST(coalesce(sum(batch_size * 4 * width) FILTER (rank = 0 AND phase = 'train'), 0) AS BIGINT) AS tokens
FROM steps GROUP BY run_id"""


def oracle_sql() -> dict[str, str]:
    """Oracle SQL by query name."""
    long_lines = "string_split_regex(text, '\\r\\n|\\n|\\r')"
    return {
        "src_lines": f"""
SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line
FROM (SELECT doc_id, {long_lines} AS l FROM documents)""",
        "src_text_files": f"""
SELECT row_number() OVER (ORDER BY doc_id, n) - 1 AS row_idx, line AS text FROM (
  SELECT doc_id, unnest(range(0, len(l))) AS n, unnest(l) AS line
  FROM (SELECT doc_id, {long_lines} AS l FROM documents))""",
        "src_dispatch": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, text FROM documents",
        "named_splits": """
SELECT 'train' AS split, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, text FROM documents
UNION ALL SELECT 'val', row_number() OVER (ORDER BY conv_id, turn) - 1, text FROM conversations""",
        "split_counts": f"WITH {DOCS} SELECT split, count(*) AS docs FROM docs GROUP BY split",
        "prepared_roundtrip": packed_view(BLOCK, ROWS, False),
        "cache_lookup": """
WITH req AS (
  SELECT c_custkey, c_custkey AS base,
         ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_custkey % 5 + 1] AS fp FROM customer),
ent AS (SELECT o_custkey AS base, o_orderpriority AS fp, o_orderdate AS created,
               'c' || o_custkey || '/' || o_orderkey AS path FROM orders),
ranked AS (
  SELECT c_custkey, path, r.fp = e.fp AS same,
         row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(r.fp = e.fp, false) DESC, created DESC, path DESC) AS rn
  FROM req r LEFT JOIN ent e USING (base))
SELECT c_custkey, CASE WHEN path IS NULL THEN 'build' WHEN same THEN 'exact' ELSE 'fallback' END AS match, path
FROM ranked WHERE rn = 1""",
        "corpus_preview": f"""
WITH {DOCS} SELECT split, row_idx, doc_id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS row_idx FROM docs) WHERE row_idx < 2""",
        "corpus_stats": f"""
WITH {totals(ROWS)}
SELECT split, CAST(b AS BIGINT) AS block_size, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(tokens) AS BIGINT) AS tokens,
       CAST(sum({made("b")}) AS BIGINT) AS blocks, min(min_len) AS min_len, max(max_len) AS max_len,
       round(sum(tokens) / sum(docs), 6) AS mean_len
FROM (SELECT *, unnest({list(BLOCK_SIZES)}) AS b FROM totals) GROUP BY split, b""",
        "tokenize_native": token_view(),
        "tokenize_file": token_view(),
        # 62 words fit beside start and end.
        "tokenize_truncated": token_view("pos <= 62 OR pos = 1000000000"),
        "special_mask": f"""
WITH {DOCS}, {VOCAB}, {TOKENS}
SELECT doc_id, CAST(sum(special) AS BIGINT) AS specials, CAST(arg_min(special, pos) AS BIGINT) AS first,
  CAST(arg_max(special, pos) AS BIGINT) AS last FROM tokens WHERE pos < 1000000000 GROUP BY doc_id""",
        "vocab_topk": f"WITH {VOCAB} SELECT token, id, freq FROM vocab",
        "vocab_check": f"""
WITH {DOCS}, {VOCAB}, {TOKENS}
SELECT split, count(*) AS tokens, max(id) AS max_id, count(*) FILTER (id >= {MODEL_VOCAB}) AS out_of_range,
       count(*) FILTER (id = {UNK}) AS unknown, round(count(*) FILTER (id = {UNK}) / count(*), 6) AS unknown_rate
FROM tokens GROUP BY split""",
        "round_up": """
SELECT l_orderkey, l_linenumber,
       CAST(ceil(CAST(l_partkey AS DOUBLE) / l_linenumber) AS BIGINT) * l_linenumber AS rounded FROM lineitem""",
        "row_index": f"""
WITH {DOCS} SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS row_idx FROM docs""",
        "shard_ranges": f"""
WITH {DOCS}, {places(SHORT_ROWS)}
SELECT split, shard, batch, min(row_idx) AS first_row, max(row_idx) AS last_row, count(*) AS docs
FROM places GROUP BY split, shard, batch""",
        "pack_blocks": packed_view(BLOCK, ROWS, False),
        "pack_blocks_short": packed_view(SHORT_BLOCK, SHORT_ROWS, True),
        "pack_dropped": f"""
WITH {totals(ROWS)}
SELECT split, shard, batch, tokens, CAST({made(BLOCK)} AS BIGINT) AS blocks,
       tokens - least(tokens, ({made(BLOCK)}) * {BLOCK}) AS dropped FROM totals""",
        "block_lengths": f"""
WITH {block_rows(SHORT_BLOCK, SHORT_ROWS)}
SELECT split, CAST(length AS BIGINT) AS length, count(*) AS blocks, CAST(0 AS BIGINT) AS uneven
FROM blocks GROUP BY split, length""",
        "shuffle_epoch": f"WITH {block_rows(BLOCK, ROWS)}, {SHUFFLED} SELECT split, block_idx, pos FROM shuffled",
        "micro_batches": f"""
WITH {block_rows(BLOCK, ROWS)}
SELECT split, block_idx, block_idx // {MICRO} AS batch_idx, block_idx % {MICRO} AS slot FROM blocks""",
        "eval_limit": f"""
WITH {block_rows(BLOCK, ROWS)},
val AS (SELECT *, block_idx AS pos FROM blocks WHERE split = 'val'), {dealt("val")}
SELECT rank, batch_idx, slot, block_idx FROM dealt WHERE batch_idx < {EVAL_SAMPLES} // {MICRO}""",
        "rank_shards": f"""
WITH {block_rows(BLOCK, ROWS)}, {SHUFFLED}, {dealt("shuffled")}
SELECT block_idx, rank, rank_pos AS pos, is_pad FROM dealt""",
        "optimizer_steps": f"""
WITH {block_rows(BLOCK, ROWS)}, {SHUFFLED}, {dealt("shuffled")}
SELECT split, batch_idx // {ACCUM} AS step, count(*) AS rows, count(*) = {MICRO * WORLD * ACCUM} AS "full"
FROM dealt GROUP BY split, batch_idx // {ACCUM}""",
        "resume_epoch": f"""
WITH RECURSIVE {block_rows(BLOCK, ROWS)},
sized AS (SELECT count(*) AS n FROM blocks WHERE split = 'train'),
root AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM sized),
ab AS (SELECT n, a, (n + a - 1) // a AS b FROM root),
slots AS (SELECT n, a, b, unnest(range({RESUME_STEP * WORLD * MICRO * ACCUM}, (n + {WORLD - 1}) // {WORLD} * {WORLD})) AS p FROM ab),
walks AS (
  SELECT * FROM (WITH src AS (SELECT p, n, a, b, p % n AS x FROM slots) {turned()})
  UNION ALL
  SELECT * FROM (WITH src AS (SELECT * FROM walks WHERE x >= n) {turned()}))
SELECT p // {WORLD} // {MICRO} // {ACCUM} AS step, p % {WORLD} AS rank, p // {WORLD} // {MICRO} AS batch_idx,
  p // {WORLD} % {MICRO} AS slot, CAST(x AS BIGINT) AS block_idx, p >= n AS is_pad FROM walks WHERE x < n""",
        "due_steps": f"""
WITH {STEPS}, p AS (SELECT run_id, passes FROM steps WHERE rank = 0 AND phase = 'train'),
m AS (SELECT run_id, passes, passes // {LOG_ACCUM} AS step,
        passes % {EVAL_EVERY * LOG_ACCUM} = 0 OR passes = {LOG_ACCUM} AS eval_due,
        passes % {SAVE_EVERY * LOG_ACCUM} = 0 AS save_due FROM p)
SELECT * FROM m WHERE eval_due OR save_due""",
        "collate_pad": f"""
WITH {block_rows(SHORT_BLOCK, SHORT_ROWS)}, {VOCAB}, {TOKENS}, {cells(SHORT_BLOCK)}, {SHUFFLED}, {ordered_batches()},
texts AS (
  SELECT split, shard, batch, blk, list(id ORDER BY cell) AS ids, list(special ORDER BY cell) AS special
  FROM cells GROUP BY split, shard, batch, blk)
SELECT split, rank, batch_idx, slot, CAST(width AS BIGINT) AS width,
  CAST(list_concat(ids, list_transform(range(0, width - length), lambda x: {PAD})) AS VARCHAR) AS ids,
  CAST(list_transform(range(0, width), lambda x: CASE WHEN x < length THEN 1 ELSE 0 END) AS VARCHAR) AS attention,
  CAST(list_concat(special, list_transform(range(0, width - length), lambda x: 1)) AS VARCHAR) AS special
FROM wide JOIN texts USING (split, shard, batch, blk)""",
        "feed_clm": f"""
WITH {block_rows(SHORT_BLOCK, SHORT_ROWS)}, {VOCAB}, {TOKENS}, {cells(SHORT_BLOCK)}, {SHUFFLED}, {ordered_batches()},
texts AS (SELECT split, shard, batch, blk, list(id ORDER BY cell) AS ids FROM cells GROUP BY split, shard, batch, blk)
SELECT split, rank, batch_idx, slot, CAST(width AS BIGINT) AS width,
  CAST(list_concat(ids, list_transform(range(0, width - length), lambda x: {PAD})) AS VARCHAR) AS ids,
  CAST(list_transform(range(0, width), lambda x: CASE WHEN x < length THEN 1 ELSE 0 END) AS VARCHAR) AS attention,
  CAST(list_concat(list_transform(ids, lambda x: CASE WHEN x = {PAD} THEN -100 ELSE x END),
                   list_transform(range(0, width - length), lambda x: -100)) AS VARCHAR) AS labels
FROM wide JOIN texts USING (split, shard, batch, blk)""",
        "feed_mlm": f"""
{acted(BLOCK, ROWS)},
lens AS (SELECT split, shard, batch, blk, count(*) AS length FROM cells GROUP BY split, shard, batch, blk),
blocks AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY shard, batch, blk) - 1 AS block_idx FROM lens),
{SHUFFLED}, {ordered_batches()},
texts AS (
  SELECT split, shard, batch, blk,
    list(CASE action WHEN 1 THEN {MASK} WHEN 2 THEN other ELSE id END ORDER BY cell) AS ids,
    list(CASE WHEN action > 0 THEN id ELSE -100 END ORDER BY cell) AS labels
  FROM acted GROUP BY split, shard, batch, blk)
SELECT split, rank, batch_idx, slot, CAST(width AS BIGINT) AS width,
  CAST(list_concat(ids, list_transform(range(0, width - length), lambda x: {PAD})) AS VARCHAR) AS ids,
  CAST(list_transform(range(0, width), lambda x: CASE WHEN x < length THEN 1 ELSE 0 END) AS VARCHAR) AS attention,
  CAST(list_concat(labels, list_transform(range(0, width - length), lambda x: -100)) AS VARCHAR) AS labels
FROM wide JOIN texts USING (split, shard, batch, blk)""",
        "labels_clm": f"""
WITH {DOCS}, {VOCAB}, {TOKENS}, {places(SHORT_ROWS)}, {cells(SHORT_BLOCK)},
texts AS (SELECT split, shard, batch, blk, list(CASE WHEN id = {PAD} THEN -100 ELSE id END ORDER BY cell) AS l
          FROM cells GROUP BY split, shard, batch, blk)
SELECT split, shard, batch, blk,
  CAST(list_concat(l, list_transform(range(0, {SHORT_BLOCK} - len(l)), lambda x: -100)) AS VARCHAR) AS labels
FROM texts""",
        "labels_mlm": f"""
{acted(BLOCK, ROWS)}
SELECT split, shard, batch, blk,
  CAST(list(CASE action WHEN 1 THEN {MASK} WHEN 2 THEN other ELSE id END ORDER BY cell) AS VARCHAR) AS ids,
  CAST(list(CASE WHEN action > 0 THEN id ELSE -100 END ORDER BY cell) AS VARCHAR) AS labels
FROM acted GROUP BY split, shard, batch, blk""",
        "mask_stats": f"""
{acted(BLOCK, ROWS)}
SELECT split, CAST(action AS BIGINT) AS action, CAST(special AS BIGINT) AS special, count(*) AS positions
FROM acted GROUP BY split, action, special""",
        "progress": f"""
WITH {COUNTED} SELECT run_id, session, batch_idx, samples, tokens FROM counted WHERE phase = 'train'""",
        "progress_at_val": f"""
WITH {COUNTED} SELECT run_id, session, batch_idx, samples, tokens FROM counted WHERE phase = 'val'""",
        "train_loss": f"""
WITH {STEPS} SELECT run_id, session, batch_idx, step, loss FROM steps WHERE rank = 0 AND phase = 'train'""",
        "val_loss": f"""
WITH {STEPS}, {VAL_LOSS} SELECT run_id, step, round(val_loss, 10) AS val_loss, ranks FROM losses""",
        "system_metrics": f"""
WITH {STEPS}, spans AS (
  SELECT run_id, session, rank, step, min(start_us) AS s, max(end_us) AS e, max(peak_bytes) AS peak
  FROM steps WHERE phase = 'val' GROUP BY run_id, session, rank, step),
timed AS (SELECT *, lag(e) OVER (PARTITION BY run_id, session, rank ORDER BY step) AS prev FROM spans)
SELECT run_id, session, step, max(peak) / 1048576 AS max_peak_mib, round(sum(s - prev) / count(*) / 1e6, 9) AS avg_seconds
FROM timed WHERE prev IS NOT NULL GROUP BY run_id, session, step""",
        "best_checkpoint": f"""
WITH {STEPS}, {CANDIDATES}
SELECT run_id, step, round(loss, 10) AS loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY loss, step) AS rn FROM candidates) WHERE rn = 1""",
        "checkpoint_name": f"""
WITH {COUNTED}, {CANDIDATES},
at_step AS (SELECT run_id, step, samples, tokens FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY batch_idx DESC) AS rn
  FROM counted WHERE phase = 'train') WHERE rn = 1)
SELECT run_id, step, printf('snap-%d-samples-%.1f-%.1f-loss-%.2f', step, CAST(samples AS DOUBLE),
                            CAST(tokens AS DOUBLE), round(loss, 8)) AS name
FROM candidates JOIN at_step USING (run_id, step)""",
        "prune_old": f"WITH {ARTIFACTS} SELECT run_id, artifact_id, iter, NOT newest AS \"delete\" FROM artifacts",
        "retention": f"""
WITH {ARTIFACTS} SELECT run_id, artifact_id, array_to_string(aliases, ',') AS aliases
FROM artifacts WHERE NOT best AND NOT kept""",
        "cache_trim": f"""
WITH {ARTIFACTS}, summed AS (
  SELECT cache_id, artifact_id, CAST(sum(size_bytes) OVER (PARTITION BY cache_id
    ORDER BY created_us DESC, artifact_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS kept_bytes FROM artifacts)
SELECT *, kept_bytes <= {CACHE_LIMIT} AS keep FROM summed""",
        "backoff_events": f"""
WITH {STEPS}, n AS (
  SELECT run_id, session, step, row_number() OVER (PARTITION BY run_id, session ORDER BY step) AS event_no
  FROM (SELECT DISTINCT run_id, session, step FROM steps WHERE phase = 'val'))
SELECT * FROM n WHERE event_no % 11 = 0""",
        "resolve_refs": f"""
WITH {ARTIFACTS}, tagged AS (
  SELECT run_id, unnest(aliases) AS tag, artifact_id, iter FROM artifacts),
newest AS (SELECT run_id, tag, arg_max(artifact_id, iter) AS artifact_id FROM tagged GROUP BY run_id, tag),
asked AS (
  SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN o_custkey END AS a, CASE o_orderkey % 4 WHEN 1 THEN o_custkey END AS b,
    CASE o_orderkey % 4 WHEN 2 THEN o_custkey END AS c, CASE o_orderkey % 4 WHEN 3 THEN o_orderkey END AS d FROM orders),
named AS (
  SELECT coalesce(a, b, c) AS run_id, CASE WHEN a IS NOT NULL THEN 'latest' WHEN b IS NOT NULL THEN 'best'
         WHEN c IS NOT NULL THEN 'keep' END AS tag,
    CASE WHEN a IS NOT NULL THEN 'wandb:' || a WHEN b IS NOT NULL THEN 'wandb:' || b || ':best'
         WHEN c IS NOT NULL THEN 'wandb:' || c || ':keep' ELSE 'out/' || d || '/model.ckpt' END AS ref FROM asked)
SELECT ref, CASE WHEN run_id IS NULL THEN ref ELSE 'model-' || run_id || ':' || tag END AS resolved, artifact_id
FROM named LEFT JOIN newest USING (run_id, tag)""",
        "final_aliases": f"""
WITH {ARTIFACTS} SELECT run_id, artifact_id,
  array_to_string(CASE WHEN newest THEN list_concat(aliases, ['train_end'])
                       ELSE aliases END, ',') AS aliases FROM artifacts""",
        "format_elapsed": f"""
WITH t AS (SELECT event_id, value * CAST([1e-6, 0.1, 10.0, 100.0, 5000.0][event_id % 5 + 1] AS DOUBLE) AS s FROM events)
SELECT event_id, {elapsed("s")} AS elapsed FROM t""",
        "metric_line": f"""
WITH {COUNTED}, t AS (SELECT *, (end_us - start_us) / 1e6 AS s FROM counted WHERE phase = 'train')
SELECT run_id, batch_idx AS step, 'train loss: ' || printf('%.3f', loss) || ', samples: ' || printf('%.3f', CAST(samples AS DOUBLE)) ||
  ', tokens: ' || printf('%.3f', CAST(tokens AS DOUBLE)) || ', batch_time: ' || {elapsed("s")} AS line FROM t""",
        "run_plan": f"""
WITH {RUNS} SELECT run_id, micro_batch, accumulation, units_per_step, goal_steps, eval_steps, save_steps,
  warmup_steps, decay_steps, valid FROM plans""",
        "run_plan_layered": """
WITH o AS (
  SELECT l_orderkey AS run_id, l_partkey % 4 AS k, l_suppkey AS seq,
    CASE WHEN l_linenumber = 7 THEN 99 ELSE l_linenumber - 1 END AS layer,
    CASE l_partkey % 4 WHEN 0 THEN l_suppkey * 1000 + 50 WHEN 1 THEN (l_suppkey % 8 + 1) * 16 WHEN 2 THEN 16
         ELSE l_suppkey % 50 + 1 END AS value FROM lineitem),
w AS (
  SELECT run_id, k, value FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, k ORDER BY layer DESC, seq DESC, value DESC) AS rn FROM o)
  WHERE rn = 1),
r AS (
  SELECT run_id, coalesce(max(value) FILTER (k = 0), 100000) AS goal, coalesce(max(value) FILTER (k = 1), 128) AS batch,
    max(value) FILTER (k = 2) AS mb, max(value) FILTER (k = 3) AS ev FROM w GROUP BY run_id),
m AS (SELECT *, coalesce(mb, batch) AS micro FROM r)
SELECT run_id, CAST(micro AS BIGINT) AS micro_batch, CAST(nullif(batch // micro, 0) AS BIGINT) AS accumulation,
  CAST(1 AS BIGINT) AS units_per_step, CAST(goal AS BIGINT) AS goal_steps,
  CAST(coalesce(CAST(ev AS DOUBLE), trunc(CAST(0.1 AS DOUBLE) * goal)) AS BIGINT) AS eval_steps,
  CAST(trunc(CAST(0.1 AS DOUBLE) * goal) AS BIGINT) AS save_steps,
  CAST(trunc(CAST(0.005 AS DOUBLE) * goal) AS BIGINT) AS warmup_steps, CAST(goal AS BIGINT) AS decay_steps,
  coalesce(batch % micro = 0 AND batch = micro * (batch // micro), false) AS valid FROM m""",
        "run_coverage": f"""
WITH {totals(ROWS)}, {RUNS},
sized_corpus AS (
  SELECT b AS block_size, CAST(sum({made("b")}) AS BIGINT) AS corpus_blocks
  FROM (SELECT *, unnest({list(BLOCK_SIZES)}) AS b FROM totals WHERE split = 'train') GROUP BY b),
covered AS (
  SELECT *, (corpus_blocks + batch_size - 1) // batch_size AS per_epoch
  FROM (SELECT * REPLACE (CASE WHEN valid THEN goal_steps END AS goal_steps) FROM plans)
  JOIN sized_corpus USING (block_size))
SELECT run_id, valid, corpus_blocks, per_epoch AS steps_per_epoch, round(goal_steps / nullif(per_epoch, 0), 6) AS epochs,
  goal_steps, goal_steps * batch_size * block_size AS tokens_seen FROM covered""",
        "layered_overrides": """
WITH o AS (
  SELECT l_orderkey AS run_id, 'k' || (l_partkey % 5) AS key,
         CAST(CASE WHEN l_linenumber = 7 THEN 99 ELSE l_linenumber - 1 END AS BIGINT) AS layer,
         l_suppkey AS seq, l_extendedprice AS value FROM lineitem)
SELECT run_id, key, layer, value FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY layer DESC, seq DESC, value DESC) AS rn FROM o)
WHERE rn = 1""",
        "stream_pack": packed_view(BLOCK, ROWS, False),
        "force_rebuild": packed_view(BLOCK, ROWS, False),
        "prepare_only": packed_view(BLOCK, ROWS, False),
        "prepared_incremental": f"""
WITH {DOCS}, {VOCAB}, {TOKENS},
idx AS (SELECT doc_id, doc_id % {ENTRIES} AS shard, row_number() OVER (PARTITION BY doc_id % {ENTRIES} ORDER BY doc_id) - 1 AS row_idx FROM docs),
places AS (SELECT doc_id, row_idx, CAST(shard AS BIGINT) AS shard, CAST(row_idx // {ROWS} AS BIGINT) AS batch FROM idx),
moved AS (SELECT * REPLACE ('train' AS split) FROM tokens), {cells(BLOCK).replace("FROM tokens t", "FROM moved t")}
SELECT split, shard, batch, blk, CAST(list(id ORDER BY cell) AS VARCHAR) AS ids,
  CAST(list(special ORDER BY cell) AS VARCHAR) AS special FROM cells GROUP BY split, shard, batch, blk""",
        "stream_totals": RUN_TOTALS,
        # Sent twice, counted once.
        "stream_totals_once": RUN_TOTALS,
        "stream_pack_carry": f"""
WITH {DOCS}, {VOCAB}, {TOKENS},
places AS (SELECT doc_id, split, doc_id AS row_idx, CAST(doc_id % {SHARDS} AS BIGINT) AS shard, CAST(0 AS BIGINT) AS batch FROM docs),
{cells(BLOCK)}
SELECT split, shard, batch, blk, CAST(list(id ORDER BY cell) AS VARCHAR) AS ids,
  CAST(list(special ORDER BY cell) AS VARCHAR) AS special FROM cells GROUP BY split, shard, batch, blk""",
    }
