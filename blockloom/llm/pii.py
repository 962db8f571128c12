"""Personal data by boosted trees over candidate spans, with DataFrame functions only.

Generators propose spans with high recall: strict patterns, whose valid matches are always kept,
and loose ones (spelled-out addresses, numbers without a country code, long IP addresses). Each
candidate becomes a row with features of its format and its context. Trees are fitted on the counts of
all strict candidates by their binned features, labelled by the checks that strict matches pass or fail, calibrated on
candidates they have not seen, and scored as one CASE expression per tree. A loose or failing candidate is
added where its probability reaches the threshold of its kind.

Matches have no positions in Spark SQL, but the pieces between them have lengths: a text is split by
a pattern and its matches are extracted, and a running sum of both gives the offsets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .boosting import Forest, bins_of, boost, calibrate, edges_of, threshold_for, values_of
from .rows import ROW

KINDS = ("email", "ip", "card", "phone")
# Different binned candidates that the trees are fitted on, and how often an added span must be right.
VECTORS = 100_000
PRECISION = 0.98
CONTEXT = 24

# Generators as (kind, strict, pattern). Quantifiers are possessive wherever that
# matches the same, so that no text makes the engine go back far or deep.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
GENERATORS = (
    (0, True, rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"),
    (1, True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (2, True, r"[0-9](?:[\x20-]?[0-9])++"),
    (3, True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    (0, False, rf"(?<!{LOCAL}){LOCAL}++\x20?(?:\[at\]|\(at\)|\{{at\}}|\x20at\x20)\x20?{LABEL}++(?:\x20?(?:\[dot\]|\(dot\)|\{{dot\}}|\x20dot\x20)\x20?{LABEL}++)++"),
    (1, False, r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])"),
    (2, False, r"(?<![0-9.])[0-9]{4}\.[0-9]{4}\.[0-9]{4}\.[0-9]{1,7}(?![0-9.])"),
    (3, False, r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"),
    (3, False, r"(?<![0-9+.-])00[1-9][0-9]?[\x20().0-9-]{6,20}[0-9](?![0-9])"),
)
# A character without which a pattern cannot match, to skip texts cheaply.
NEEDS = ("@", ".", None, "+", "at", ":", ".", None, "00")
# A part may be zeros only, so what follows them may be missing.
OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?+"
CONTEXT_WORDS = (
    "mail|contact|write|address|kontakt|correo",
    r"\bip\b|host|server|client|addr|login",
    "card|visa|credit|debit|amex|account|karte|tarjeta|carte",
    r"phone|\btel|mobile|call|fax|cell|telefon",
)


def _candidate(gen: int):
    return lambda x, i: F.struct(
        F.lit(gen).alias("gen"),
        i.alias("idx"),
        F.char_length(x["l"]).cast("long").alias("gap"),
        x["m"].alias("m"),
        F.right(x["l"], F.lit(CONTEXT)).alias("l"),
        F.left(x["r"], F.lit(CONTEXT)).alias("r"),
    )


def candidates_in(text: Column) -> Column:
    """Candidates of every generator as ``(gen, idx, gap, m, l, r)``, in the order of the text.

    ``gap`` is the distance from the end of the candidate before, in code points.
    """
    found = []
    for gen, ((_, _, pattern), needed) in enumerate(zip(GENERATORS, NEEDS)):
        pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        zipped = F.arrays_zip(
            matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("l"), F.slice(pieces, 2, F.size(matches)).alias("r")
        )
        both = F.transform(zipped, _candidate(gen))
        none = F.array().cast("array<struct<gen:int,idx:int,gap:bigint,m:string,l:string,r:string>>")
        possible = F.contains(text, F.lit(needed)) if needed else text.rlike(r"[0-9][\x20-]?[0-9]" if gen == 2 else "[0-9]{4}")
        found.append(F.when(possible, both).otherwise(none))
    return F.concat(*found)


def _pick(gen: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), gen)


def _only(text: Column, keep: str) -> Column:
    return F.regexp_replace(text, f"[^{keep}]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.when(
        n.between(12, 19), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0
    ).otherwise(False)


def with_offsets(scanned: DataFrame) -> DataFrame:
    """``(row, gen, m, l, r, start, end)`` of all candidates; a running sum within row and generator."""
    rows = scanned.select(ROW, F.explode("candidates").alias("c")).select(ROW, "c.*")
    sofar = Window.partitionBy(ROW, "gen").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("m")).over(sofar)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("m")).drop("idx", "gap")


def with_checks(rows: DataFrame) -> DataFrame:
    """Add ``kind``, ``strict``, ``digits`` and ``valid``: whether the candidate passes the check of its kind."""
    rows = rows.withColumn("kind", _pick(F.col("gen"), [g[0] for g in GENERATORS])).withColumn(
        "strict", _pick(F.col("gen"), [g[1] for g in GENERATORS])
    )
    rows = rows.withColumn("digits", _only(F.col("m"), "0-9"))
    n = F.length("digits")
    luhn = F.when(F.col("kind") == 2, _luhn(F.col("digits"))).otherwise(False)
    octets = F.col("m").rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    rows = rows.withColumn("luhn", luhn).withColumn("octets", F.when(F.col("kind") == 1, octets).otherwise(False))
    valid = (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.col("octets"))
        .when(F.col("kind") == 2, F.col("luhn"))
        .otherwise(n.between(9, 15))
    )
    return rows.withColumn("valid", valid)


FEATURES = (
    *[f"is_{k}" for k in KINDS],
    "length", "n_digits", "n_letters", "n_dots", "n_dashes", "n_spaces", "n_brackets", "passes_luhn", "passes_octets",
    "last_label", "digit_share", "run_before", "run_after", *[f"near_{k}" for k in KINDS],
)


def with_features(rows: DataFrame) -> DataFrame:
    m, left, right = F.col("m"), F.col("l"), F.col("r")
    size = F.char_length(m)
    values = {
        **{f"is_{k}": F.col("kind") == i for i, k in enumerate(KINDS)},
        "length": size,
        "n_digits": F.length("digits"),
        "n_letters": F.length(_only(m, "A-Za-z")),
        "n_dots": F.length(_only(m, ".")),
        "n_dashes": F.length(_only(m, "-")),
        "n_spaces": F.length(_only(m, r"\x20")),
        "n_brackets": F.length(_only(m, r"()\[\]{}")),
        "passes_luhn": F.col("luhn"),
        "passes_octets": F.col("octets"),
        "last_label": F.length(F.regexp_extract(m, r"([A-Za-z0-9-]*)\z", 1)),
        "digit_share": F.length("digits") / F.greatest(size, F.lit(1)),
        "run_before": F.length(F.regexp_extract(left, r"([A-Za-z0-9._%+-]*)\z", 1)),
        "run_after": F.length(F.regexp_extract(right, r"\A([A-Za-z0-9._%+-]*)", 1)),
        **{f"near_{k}": left.rlike(f"(?i){w}") for k, w in zip(KINDS, CONTEXT_WORDS)},
    }
    return rows.select("*", *[values[f].cast("double").alias(f) for f in FEATURES])


def fit(rows: DataFrame, sample: int = VECTORS, precision: float = PRECISION) -> tuple[Forest, list[float]]:
    """Trees and the threshold of each kind, from all strict candidates.

    Candidates are counted by their features, cut into bins as the trees would cut them; trees, calibration and
    thresholds take these counts. More than ``sample`` different ones are counted in wider bins: candidates are
    never left out. The hash of a candidate and its context says whether the trees see it, so every run fits
    the same. A kind without enough right candidates gets a threshold that nothing reaches.
    """
    unseen = (F.pmod(F.xxhash64("m", "l", "r"), F.lit(4)) == 0).alias("unseen")
    known = rows.filter("strict").select(unseen, "valid", "kind", *FEATURES)
    vectors = stored(known.groupBy("unseen", "valid", "kind", *FEATURES).agg(F.count(F.lit(1)).alias("n")), "pii-vectors")
    edges = edges_of(vectors.filter("not unseen"), list(FEATURES), "n")
    while True:
        binned = vectors.select("unseen", "valid", "kind", "n", *bins_of(list(FEATURES), edges))
        counted = stored(binned.groupBy("unseen", "valid", "kind", *FEATURES).agg(F.sum("n").alias("n")), "pii-counts")
        if max(map(len, edges)) < 2 or counted.count() <= sample:
            break
        edges = [e[len(e) > 1 :: 2] for e in edges]
    drawn = np.array(sorted(tuple(int(v) for v in r) for r in counted.select("unseen", "valid", "kind", "n", *FEATURES).collect()))
    if not len(drawn):
        return Forest(0.0, []), [1.01] * len(KINDS)
    unseen, y, kind, n = drawn[:, 0] == 1, drawn[:, 1], drawn[:, 2], drawn[:, 3].astype(float)
    x = values_of(drawn[:, 4:], edges)
    forest = boost(x[~unseen], y[~unseen], edges=edges, count=n[~unseen])
    forest = calibrate(forest, x[unseen], y[unseen], n[unseen])
    p = 1 / (1 + np.exp(-np.clip(forest.log_odds(x), -500, 500)))
    limits = []
    for k in range(len(KINDS)):
        some = unseen & (kind == k)
        # At least even odds, so that a kind without wrong candidates does not take everything.
        limits.append(max(0.5, threshold_for(p[some], y[some], precision, n[some])) if some.any() else 1.01)
    return forest, limits


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = VECTORS) -> DataFrame:
    """``(row, key, base, added)`` per row, both arrays of ``(start, kind, end)`` sorted.

    ``base`` are the valid strict matches, ``added`` the other candidates that the trees select and
    that overlap no base span and no better added one. Positions are code points, ends exclusive.

    Nulls: a null text counts as empty; null keys stay null. Repeated rows are searched each. Other
    columns are ignored. An empty table gives an empty one.
    """
    src = docs.select(F.monotonically_increasing_id().alias(ROW), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    scanned = stored(src.select(ROW, "key", candidates_in(F.col("t")).alias("candidates")), "pii-candidates")
    rows = stored(with_features(with_checks(with_offsets(scanned))), "pii-features")
    forest, limits = fit(rows, sample)
    base = F.col("strict") & F.col("valid")
    scored = rows.select(ROW, "start", "kind", "end", base.alias("base"), forest.column(list(FEATURES)).alias("p"))
    chosen = scored.filter(F.col("base") | (F.col("p") >= _pick(F.col("kind"), limits)))
    span = F.struct("start", "kind", "end")
    per_row = chosen.groupBy(ROW).agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        # Sorted by probability, then length and place: what overlaps an earlier entry is not added.
        F.collect_set(F.when(~F.col("base"), F.struct("start", "kind", "end", "p"))).alias("more"),
    )

    def better(a: Column, b: Column) -> Column:
        def rank(x):
            return F.struct(x["p"], x["end"] - x["start"], -x["start"], -x["kind"])

        return rank(b) > rank(a)

    free = F.filter("more", lambda a: ~F.exists("base", lambda b: _overlaps(a, b)))
    best = F.filter(
        "more", lambda a: ~F.exists("more", lambda b: _overlaps(a, b) & better(a, b))
    )
    added = F.array_sort(F.transform(best, lambda a: F.struct(a["start"], a["kind"], a["end"])))
    found = per_row.withColumn("more", free).select(ROW, "base", added.alias("added"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return scanned.select(ROW, "key").join(found, ROW, "left").select(
        ROW, F.col("key").alias(key), F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added")
    )


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redacted(text: Column, spans: Column) -> Column:
    """A text with its spans replaced by the kind in brackets; of overlapping spans the first one counts."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        done = F.concat(state["out"], between, F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), done.alias("out")))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.char_length(text)))

    return F.aggregate(spans, start, cut, finish)
