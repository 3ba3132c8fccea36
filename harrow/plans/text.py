"""Text operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harrow.functions import text as t
from harrow.plans.registry import query
from harrow.plans.tables import read

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\A\s+|\s+\z', '', 'g')"
_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9+#./&\\- ]+', ' ', 'g'), ' +', ' ', 'g'))"
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(" + _NORM + ", '[^a-z0-9+#]+'), lambda x: length(x) > 1 OR regexp_matches(x, '^[0-9]$')))"


@query("ST1_clean_text", f"SELECT doc_id, sha256({_CLEAN}) AS cleaned FROM documents")
def clean_text(s, d):
    return read(s, d, "documents").select("doc_id", F.sha2(t.clean(F.col("text")), 256).alias("cleaned"))


@query("ST2_word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS words FROM documents")
def word_count(s, d):
    return read(s, d, "documents").select("doc_id", t.word_count(F.col("text")).cast("long").alias("words"))


@query("ST3_whitespace", r"SELECT doc_id, CASE WHEN length(text) = 0 THEN 10000 ELSE ((length(text) - length(regexp_replace(text, '\s', '', 'g'))) * 20000 + length(text)) // (2 * length(text)) END AS share FROM documents")
def whitespace(s, d):
    return read(s, d, "documents").select("doc_id", t.blank_share(F.col("text")).cast("long").alias("share"))


@query("ST4_language_hint", r"SELECT hint, lang, count(*) AS n FROM (SELECT lang, CASE WHEN odd > 0.15 * length(head) THEN 'non_en' WHEN words >= 10 THEN 'en' END AS hint FROM (SELECT lang, head, length(head) - length(regexp_replace(head, '[^\x00-\x7F]', '', 'g')) AS odd, len(regexp_extract_all(head, '[A-Za-z]+')) AS words FROM (SELECT lang, substr(text, 1, 5000) AS head FROM documents))) GROUP BY ALL")
def language_hint(s, d):
    return read(s, d, "documents").groupBy(t.language_hint(F.col("text")).alias("hint"), "lang").agg(F.count("*").alias("n"))


@query("ST6_norm", f"SELECT conv_id, turn, {_NORM.format('text')} AS normed FROM conversations")
def norm(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", t.norm(F.col("text")).alias("normed"))


@query("ST7_tokens", f"SELECT conv_id, turn, array_to_string(list_sort({_TOKENS.format('text')}), ' ') AS tokens FROM conversations")
def tokens(s, d):
    return read(s, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(t.tokens(F.col("text"))), " ").alias("tokens"))


_TURNS = f"WITH turns AS (SELECT conv_id, turn, {_TOKENS.format('text')} AS a, {_TOKENS.format('first')} AS b FROM (SELECT *, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM conversations))"


def _turns(s, d):
    return _turns_of(read(s, d, "conversations"))


def _turns_of(rows):
    first = F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("first", first).select("conv_id", "turn", t.tokens(F.col("text")).alias("a"), t.tokens(F.col("first")).alias("b"))


@query("ST8_token_f1", f"{_TURNS} SELECT conv_id, turn, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS f1 FROM turns")
def token_f1(s, d):
    return _turns(s, d).select("conv_id", "turn", t.token_f1(F.col("a"), F.col("b")).alias("f1"))


@query("ST10_containment", f"{_TURNS} SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(a) END AS share FROM turns")
def containment(s, d):
    return _turns(s, d).select("conv_id", "turn", t.containment(F.col("a"), F.col("b")).cast("double").alias("share"))


#: Every conversation, and after it its first turn once more with two words that are new.
_ECHOED = "(SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, 1000, text || ' echoed anew' FROM conversations WHERE turn = 0)"


@query("ST11_echo", f"{_TURNS.replace(chr(70) + 'ROM conversations', 'FROM ' + _ECHOED)} SELECT conv_id, turn FROM turns WHERE turn > 0 AND len(a) > 0 AND len(list_intersect(a, b)) >= 0.85 * len(a) AND len(a) - len(list_intersect(a, b)) <= 3")
def echo(s, d):
    """Turns that repeat the conversation's first one: nearly all tokens, at most three new ones."""
    both, n = F.size(F.array_intersect("a", "b")), F.size("a")
    told = read(s, d, "conversations").select("conv_id", "turn", "text")
    rows = told.unionByName(told.where("turn = 0").select("conv_id", F.lit(1000).cast("long").alias("turn"), F.concat("text", F.lit(" echoed anew")).alias("text")))
    return _turns_of(rows).where((F.col("turn") > 0) & (n > 0) & (both >= 0.85 * n) & (n - both <= 3)).select("conv_id", "turn")


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(lower(x))), lambda x: x <> '')"


@query("ST12_duplicate_lines", f"SELECT doc_id, CASE WHEN len(l) < 4 THEN 0.0::DOUBLE ELSE 1 - len(list_distinct(l))::DOUBLE / len(l) END AS share FROM (SELECT doc_id, {_LINES} AS l FROM documents)")
def duplicate_lines(s, d):
    lines = read(s, d, "documents").select("doc_id", t.line_keys(F.col("text")).alias("l"))
    return lines.select("doc_id", F.when(F.size("l") < 4, 0.0).otherwise(1 - F.size(F.array_distinct("l")) / F.size("l")).alias("share"))


@query("ST13_structured_rows", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ': ') OR contains(x, ' | '))) AS n FROM documents")
def structured_rows(s, d):
    return read(s, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: x.contains(": ") | x.contains(" | "))).cast("long").alias("n"))


#: Phrases looked for as whole tokens.
PHRASES = ("java", "javascript", "c++", "c#", "python", "the", "and", "de", "la", "und")


@query("ST15_whole_token", "SELECT p, count(*) AS n FROM documents, (VALUES " + ", ".join(f"('{p}')" for p in PHRASES) + ") v(p) WHERE contains(' ' || regexp_replace(lower(text), '[^a-z0-9+#]+', ' ', 'g') || ' ', ' ' || p || ' ') GROUP BY p")
def whole_token(s, d):
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z0-9+#]+", " "), F.lit(" "))
    found = F.filter(F.array(*map(F.lit, PHRASES)), lambda p: F.col("padded").contains(F.concat(F.lit(" "), p, F.lit(" "))))
    return read(s, d, "documents").select(padded.alias("padded")).select(F.explode(found).alias("p")).groupBy("p").agg(F.count("*").alias("n"))


def _redacted_sql() -> str:
    out = "text"
    for pattern, by in t.SECRETS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return out


@query("ST18_redact", f"SELECT doc_id, sha256({_redacted_sql()}) AS redacted FROM documents")
def redact(s, d):
    return read(s, d, "documents").select("doc_id", F.sha2(t.redact(F.col("text")), 256).alias("redacted"))


@query("ST20_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug(s, d):
    return read(s, d, "part").select("p_partkey", t.slug(F.col("p_name")).alias("slug"))


@query("DT1_years", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b(?:19[7-9][0-9]|20[0-4][0-9])\b'))), ' ') AS years FROM documents")
def years(s, d):
    return read(s, d, "documents").select("doc_id", F.array_join(t.year_tokens(F.col("text")), " ").alias("years"))


@query("DT5_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%dT%H') AS hour FROM events")
def iso(s, d):
    return read(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.date_format("ts", "yyyy-MM-dd'T'HH").alias("hour"))


@query("MA3_ratio", "SELECT user_id, coalesce(count(*) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (event_type = 'view'), 0), 0) AS ratio FROM events GROUP BY user_id")
def ratio(s, d):
    e = F.col("event_type")
    return read(s, d, "events").groupBy("user_id").agg(F.coalesce(F.try_divide(F.count_if(e == "purchase").cast("double"), F.count_if(e == "view")), F.lit(0.0)).alias("ratio"))


@query("MA4_backoff", "SELECT l_linenumber AS attempt, least(300, 5 * power(2, greatest(l_linenumber - 1, 0)))::BIGINT AS seconds, count(*) AS n FROM lineitem GROUP BY ALL")
def backoff(s, d):
    n = F.col("l_linenumber")
    return read(s, d, "lineitem").groupBy(n.alias("attempt"), F.least(F.lit(300), F.lit(5) * F.power(F.lit(2), F.greatest(n - 1, F.lit(0)))).cast("long").alias("seconds")).agg(F.count("*").alias("n"))
