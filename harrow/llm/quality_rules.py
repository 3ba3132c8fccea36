"""Quality rules with adaptive thresholds: quantile sketches for each language and source instead of fixed cutoffs.

A text fails the base rules with fewer than 50 words, or with more than half of its words in repeated windows of three. Of the others,
six shares (thousandths: word length, symbols, marks, capitals, repeated lines, repeated words) go into one sketch for each language and
source: counts of logarithmic buckets, 32 for each power of two, exact below 64. Sketches merge by adding counts, so they are built by
partial aggregation, and those of a language and of all texts are sums of the sources'. A group's limits lie at its median,
plus FACTOR times its lower half's spread (median less lower quartile, which junk above the median doesn't widen), plus a margin; word
length has a lower limit as well. A source of fewer than LEAST texts takes its language's limits, a language of fewer those of all.
The limits are joined with the measures, never with the texts.

A null text has no words; null languages and sources count as empty ones. Every row gets its own verdict, repeated ids too; ties
at a limit are kept. No text that passes the base rules: no limits, nothing else fails. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices, text_buffer

SYMBOLS = b"#*$%&|<>"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_MARK &= ~_SYMBOL
#: Base rules; spread factor; texts a group needs for limits of its own; groups up to which limits are broadcast, salts beyond.
MIN_WORDS, MAX_REPEAT, FACTOR, LEAST, BROADCAST_GROUPS, SALTS = 50, 50, 8, 200, 50_000, 32
#: Of each share: its numerator, denominator, margin, and whether it has a lower limit.
SHARES = {
    "length": ("word_chars", "n_words", 1500, True), "symbols": ("n_symbols", "n_words", 100, False), "marks": ("n_marks", "n_words", 250, False),
    "capitals": ("n_capitals", "word_chars", 150, False), "lines": ("n_dup_lines", "n_lines", 500, False), "repeats": ("n_repeat_words", "n_words", 400, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")


def _identities(buffer: np.ndarray, keep: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each span, equal for equal bytes: the spans' kept bytes one after the other, dictionary-encoded."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    spans = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(buffer[keep])])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def measures(buffer: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    texts = len(offsets) - 1
    inside = ~_BLANK[buffer]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inside[heads]
    at = np.flatnonzero(begin)

    def total(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buffer) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return np.diff(sums[offsets])

    out = {"n_words": np.diff(np.searchsorted(at, offsets)), "word_chars": total(inside & ((buffer & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[buffer])}
    out |= {"n_marks": total(_MARK[buffer]), "n_capitals": total((buffer >= 65) & (buffer <= 90))}

    # lines that hold a word, and those of them equal to an earlier one of their text
    stops = np.flatnonzero(buffer == 10) + 1
    lines = np.union1d(heads, stops[stops < len(buffer)]).astype(np.int64)
    out["n_lines"] = out["n_dup_lines"] = np.zeros(texts, np.int64)
    if len(lines):
        edges = np.r_[lines, len(buffer)]
        solid = buffer != 10
        kept = np.zeros(len(buffer) + 1, np.int64)
        np.cumsum(solid, out=kept[1:])
        spoken = np.diff(np.searchsorted(at, edges)) > 0
        name = _identities(buffer, solid, np.diff(kept[edges]))[spoken]
        owner = (np.searchsorted(offsets, lines, side="right") - 1)[spoken]
        distinct = np.unique(owner * (name.max(initial=0) + 1) + name) // (name.max(initial=0) + 1)
        out["n_lines"] = np.bincount(owner, minlength=texts)
        out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct, minlength=texts)

    # words in windows of three that their text holds twice
    out["n_repeat_words"] = np.zeros(texts, np.int64)
    if len(at) > 3:
        size = np.zeros(len(buffer) + 1, np.int64)
        np.cumsum(inside, out=size[1:])
        word = _identities(buffer, inside, np.diff(size[np.r_[at, len(buffer)]]))
        owner = np.repeat(np.arange(texts), out["n_words"])
        many = int(word.max()) + 1
        _, pair = np.unique(word[:-2] * many + word[1:-1], return_inverse=True)
        whole = np.flatnonzero(owner[2:] == owner[:-2])
        window = (owner[whole] * (int(pair.max()) + 1) + pair[whole]) * many + word[whole + 2]
        _, which, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = whole[count[which] > 1]
        covered = np.zeros(len(at), bool)
        for k in range(3):
            covered[twice + k] = True
        out["n_repeat_words"] = np.bincount(owner[covered], minlength=texts)
    return out


def measure(documents: DataFrame, column: str) -> DataFrame:
    """Add a struct of the COUNTS of each whole text; every row and column stays."""
    at, names, schema = documents.columns.index("text"), documents.columns, documents.schema.simpleString()[7:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                found = measures(*text_buffer(part.column(at)))
                counts = pa.StructArray.from_arrays([pa.array(found[c].astype(np.int64)) for c in COUNTS], list(COUNTS))
                yield pa.RecordBatch.from_arrays([*part.columns, counts], [*names, column])

    return documents.mapInArrow(run, f"{schema}, {column} struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])


def share(m: Column, name: str) -> Column:
    part, all_, _, _ = SHARES[name]
    whole, by = 1000 * m[part], F.greatest(m[all_], F.lit(1).cast("bigint"))  # nothing to divide by only where the base rules fail
    return ((whole - F.pmod(whole, by)) / by).cast("bigint")


def bucket(value: Column) -> Column:
    """The least value of the bucket: all but the six leading binary digits become zeros."""
    places = F.length(F.bin(value))
    return F.when(value < 64, value).otherwise(value - F.pmod(value, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(places - 6, F.lit(0)))))


def sketches(rows: DataFrame, m: Column) -> DataFrame:
    """(lang, source, share, bucket, n) of the texts that pass the base rules. Rows have lang_ and source_."""
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("share"), bucket(share(m, name)).alias("bucket")) for name in SHARES]))
    return rows.where(~base_failed(m)).select("lang_", "source_", values.alias("s")).groupBy("lang_", "source_", "s.share", "s.bucket").agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """The sketches of coarser groups: sums of the finer ones' counts."""
    return sketch.groupBy(*keys, "share", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, share, total, low, mid): texts, lower quartile and median of every sketch. A window holds a sketch's buckets: some 2,000 at most."""
    group = Window.partitionBy(*keys, "share")
    rows = sketch.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("total"))
    least = lambda parts: F.min(F.when(parts * F.col("upto") >= F.col("total"), F.col("bucket")))
    return rows.groupBy(*keys, "share", "total").agg(least(4).alias("low"), least(2).alias("mid"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang_, source_, least, most): the limits of every share, as maps, from the finest group that has enough texts."""
    level = lambda frame, name: F.struct(*[F.col(c) for c in ("total", "low", "mid")]).alias(name)
    own = quartiles(sketch, "lang_", "source_")
    lang = quartiles(merge(sketch, "lang_"), "lang_")
    all_ = quartiles(merge(sketch))
    rows = own.select("lang_", "source_", "share", level(own, "own")).join(lang.select("lang_", "share", level(lang, "lang")), ["lang_", "share"]).join(F.broadcast(all_.select("share", level(all_, "all"))), "share")  # six rows
    q = F.when(F.col("own.total") >= LEAST, F.col("own")).when(F.col("lang.total") >= LEAST, F.col("lang")).otherwise(F.col("all"))
    margin = F.create_map(*[F.lit(x) for name, (_, _, extra, _) in SHARES.items() for x in (name, extra)])
    rows = rows.select("lang_", "source_", "share", q.alias("q")).withColumn("room", FACTOR * (F.col("q.mid") - F.col("q.low")) + margin[F.col("share")])
    pair = lambda value: F.map_from_entries(F.collect_list(F.struct("share", value)))
    return rows.groupBy("lang_", "source_").agg(pair(F.col("q.mid") - F.col("room")).alias("least"), pair(F.col("q.mid") + F.col("room")).alias("most"))


def _keyed(rows: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.withColumns({"lang_": empty("lang"), "source_": empty("source")})


def judged(measured: DataFrame, column: str, bounds: DataFrame, failed: str, kept: str) -> DataFrame:
    """Add the base rules' result and the verdict by the limits of the row's language and source.

    Limits are broadcast up to a checked number of groups; beyond it both sides are dealt by group and salt, so that no source fills a task.
    """
    keys, few = ["lang_", "source_"], bounds.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rows = _keyed(measured)
    if few:
        rows = rows.join(F.broadcast(bounds), keys, "left")
    else:
        salted = bounds.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt_", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt_"], "left")
    m, fine = F.col(column), F.lit(True)
    for name, (_, _, _, lower) in SHARES.items():
        value = share(m, name)
        fine = fine & (value <= F.col("most")[name])
        if lower:
            fine = fine & (value >= F.col("least")[name])
    bad = base_failed(m)
    return rows.select(*[F.col(f"`{c}`") for c in measured.columns], bad.alias(failed), (~bad & F.coalesce(fine, F.lit(False))).alias(kept))


def rule_verdicts(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    measured = settle(measure(documents.select("doc_id", "lang", "source", "text"), "m").drop("text"), "rules")
    bounds = settle(limits(sketches(_keyed(measured), F.col("m"))), "limits")
    rows = judged(measured, "m", bounds, "base_failed", "kept")
    return rows.select("doc_id", *[F.col(f"m.{c}") for c in COUNTS[:5]], "base_failed", "kept")


def keep_documents(documents: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns. Texts are read twice and never shuffled."""
    names = {c: f"c{k}" for k, c in enumerate(documents.columns) if c not in ("lang", "source", "text")}
    plain = documents.withColumnsRenamed(names)
    bounds = settle(limits(sketches(_keyed(measure(plain.select("lang", "source", "text"), "m").drop("text")), F.col("m"))), "limits")
    return judged(measure(plain, "m"), "m", bounds, "failed", "kept").where("kept").select(*[F.col(names.get(c, c)).alias(c) for c in documents.columns])


_B = "[\\x20\\x09-\\x0D]"
_VALUES = {name: f"1000 * {part} // {all_}" for name, (part, all_, _, _) in SHARES.items()}
_Q = "CASE WHEN o.total >= {0} THEN o.{1} WHEN l.total >= {0} THEN l.{1} ELSE a.{1} END"


def _quartiles(name: str, sketch: str, keys: str) -> str:
    by = f"{keys}, share" if keys else "share"
    return f"""{name} AS (SELECT {by}, total, min(bucket) FILTER (4 * upto >= total) AS low, min(bucket) FILTER (2 * upto >= total) AS mid FROM (
SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM ({sketch})) GROUP BY {by}, total)"""


ORACLE_SQL = f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{_B}+'), lambda x: x <> '') AS w FROM d),
t AS (SELECT i, unnest(range(1, len(w) - 1)) AS p, w FROM w), g AS (SELECT i, p, count(*) OVER (PARTITION BY i, w[p], w[p + 1], w[p + 2]) AS c FROM t),
r AS (SELECT i, count(DISTINCT p + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS v(k) WHERE c > 1 GROUP BY i),
n AS (SELECT i, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT i, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY i),
m AS (SELECT i, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[!"''()+,\\-./:;=?@\\[\\\\\\]^_`{{}}~]', '', 'g')) AS n_marks, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN n USING (i) LEFT JOIN r USING (i)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m),
s AS (SELECT i, lang, source, share, value FROM (SELECT i, lang, source, unnest([{", ".join(f"{{'share': '{k}', 'value': {x}}}" for k, x in _VALUES.items())}], recursive := true) FROM b WHERE NOT base_failed)),
k AS (SELECT lang, source, share, CASE WHEN value < 64 THEN value ELSE value - value % (1::BIGINT << (length(bin(value)) - 6)) END AS bucket, count(*) AS n FROM s GROUP BY ALL),
{_quartiles("o", "FROM k", "lang, source")}, {_quartiles("l", "SELECT lang, share, bucket, sum(n) AS n FROM k GROUP BY ALL", "lang")}, {_quartiles("a", "SELECT share, bucket, sum(n) AS n FROM k GROUP BY ALL", "")},
q AS (SELECT o.lang, o.source, o.share, {_Q.format(LEAST, "low")} AS low, {_Q.format(LEAST, "mid")} AS mid FROM o JOIN l ON l.lang = o.lang AND l.share = o.share JOIN a ON a.share = o.share),
e AS (SELECT *, {FACTOR} * (mid - low) + CASE share {" ".join(f"WHEN '{k}' THEN {x[2]}" for k, x in SHARES.items())} END AS room FROM q),
x AS (SELECT DISTINCT i FROM s JOIN e USING (lang, source, share) WHERE value > mid + room OR (share IN ({", ".join(f"'{k}'" for k, x in SHARES.items() if x[3])}) AND value < mid - room))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND i NOT IN (SELECT i FROM x) AS kept FROM b"""
