"""Inventory of a document collection: tree, formats, hashes, statistics, duplicates, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.plans.registry import query
from harrow.plans.tables import read


def files(s, d) -> DataFrame:
    """The documents as files: path, format (here the language), size, hash."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")))
    return read(s, d, "documents").select("doc_id", path.alias("path"), F.col("lang").alias("format"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"), "text")


_FILES = "WITH files AS (SELECT doc_id, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.txt' AS path, lang AS format, strlen(text) AS size, sha256(text) AS hash, text FROM documents)"


@query("SRC5_tree", f"{_FILES}, parts AS (SELECT string_split(path, '/') AS p FROM files), dirs AS (SELECT array_to_string(p[1:k], '/') AS dir, k AS depth FROM parts, (VALUES (1), (2)) v(k)) SELECT dir, depth::BIGINT AS depth, count(*) AS files FROM dirs GROUP BY ALL")
def tree(s, d):
    parts = files(s, d).select(F.split("path", "/").alias("p"))
    dirs = parts.select(F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"), "p").select(F.array_join(F.slice("p", 1, F.col("k")), "/").alias("dir"), F.col("k").cast("long").alias("depth"))
    return dirs.groupBy("dir", "depth").agg(F.count("*").alias("files"))


_FORMAT = "CASE WHEN head LIKE '%PDF-%' AND substr(head, 1, 5) = '%PDF-' THEN 'pdf' WHEN substr(head, 1, 5) = '{\\rtf' THEN 'rtf' WHEN lower(ltrim(head)) LIKE '<!doctype html%' OR lower(ltrim(head)) LIKE '<html%' THEN 'html' WHEN url LIKE '%.html' THEN 'html' ELSE 'unknown' END"


@query("SRC6_format", f"SELECT fmt, count(*) AS n FROM (SELECT {_FORMAT} AS fmt FROM (SELECT url, substr(html, 1, 64) AS head FROM pages)) GROUP BY fmt")
def formats(s, d):
    """Magic first, then the extension."""
    head = F.substring("html", 1, 64)
    start = F.lower(F.ltrim(head))
    fmt = F.when(F.substring(head, 1, 5) == "%PDF-", "pdf").when(F.substring(head, 1, 5) == "{\\rtf", "rtf").when(start.startswith("<!doctype html") | start.startswith("<html"), "html").when(F.col("url").endswith(".html"), "html").otherwise("unknown")
    return read(s, d, "pages").groupBy(fmt.alias("fmt")).agg(F.count("*").alias("n"))


@query("MA1_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def content_hash(s, d):
    return read(s, d, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("hash"))


@query("WN1_duplicates", "SELECT doc_id, nullif(min(doc_id) OVER (PARTITION BY sha256(text)), doc_id) AS duplicate_of FROM documents")
def duplicates(s, d):
    """The first file of the same content; an aggregate by hash joined back, so that no window holds a hot group's texts."""
    rows = files(s, d).select("doc_id", "hash")
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "hash").select("doc_id", F.when(F.col("first") != F.col("doc_id"), F.col("first")).alias("duplicate_of"))


@query("WN5_sample", f"{_FILES}, ranked AS (SELECT doc_id, path, row_number() OVER (PARTITION BY format ORDER BY sha256(path)) AS k, (SELECT count(DISTINCT format) FROM files) AS n FROM files) SELECT doc_id, path FROM ranked WHERE k <= greatest(1, 40 // n)")
def sample(s, d):
    """The same number of files of each format, by the hash of their paths, 40 in all."""
    rows = files(s, d).select("doc_id", "path", "format")
    many = rows.agg(F.count_distinct("format").alias("n"))
    rank = F.row_number().over(Window.partitionBy("format").orderBy(F.sha2("path", 256)))
    return rows.withColumn("k", rank).where("k <= 40").join(F.broadcast(many), F.expr("k <= greatest(1, 40 div n)")).select("doc_id", "path")  # one row is broadcast


@query("AG21_statistics", f"{_FILES} SELECT format, count(*) AS n, sum(size)::BIGINT AS total, (2 * sum(size) + count(*))::BIGINT // (2 * count(*)) AS mean, min(size) AS low, max(size) AS high, quantile_cont(size, 0.5) AS p50, quantile_cont(size, 0.9) AS p90, quantile_cont(size, 0.99) AS p99, count(*) FILTER (size = 0) AS empty, arg_max(path, (size, -doc_id)) AS largest, arg_min(path, (size, doc_id)) AS smallest FROM files GROUP BY format")
def statistics(s, d):
    """Out of a histogram of each format's sizes: percentiles hold distinct sizes with their counts, no rows."""
    hist = files(s, d).groupBy("format", "size").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "path")).alias("first"))
    total, n = F.sum(F.col("size") * F.col("n")), F.sum("n")
    points = F.percentile("size", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), F.col("n"))
    grouped = hist.groupBy("format").agg(n.alias("n"), total.alias("total"), F.expr("(2 * sum(size * n) + sum(n)) div (2 * sum(n))").alias("mean"), F.min("size").alias("low"), F.max("size").alias("high"), points.alias("p"), F.sum(F.when(F.col("size") == 0, F.col("n")).otherwise(0)).alias("empty"), F.max_by("first", "size").alias("l"), F.min_by("first", "size").alias("m"))
    return grouped.select("format", "n", "total", "mean", "low", "high", "empty", F.col("l.path").alias("largest"), F.col("m.path").alias("smallest"), *[F.get("p", F.lit(k)).alias(name) for k, name in enumerate(("p50", "p90", "p99"))])


@query("AG22_quality", f"{_FILES}, m AS (SELECT count(*) AS n, count(DISTINCT hash) AS u, count(*) FILTER (size = 0) AS z, count(*) FILTER (size < 50) AS small FROM files) SELECT category, score, weight, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade FROM (SELECT 'uniqueness' AS category, 100 * u // n AS score, 40 AS weight FROM m UNION ALL SELECT 'readable', 100 * (n - z) // n, 35 FROM m UNION ALL SELECT 'substance', 100 * (n - small) // n, 25 FROM m)")
def quality(s, d):
    """Category scores of the collection in whole per cent, from one pass."""
    m = files(s, d).agg(F.count("*").alias("n"), F.count_distinct("hash").alias("u"), F.count_if(F.col("size") == 0).alias("z"), F.count_if(F.col("size") < 50).alias("small"))
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.expr(x).alias("score"), F.lit(w).alias("weight")) for c, x, w in (("uniqueness", "100 * u div n", 40), ("readable", "100 * (n - z) div n", 35), ("substance", "100 * (n - small) div n", 25))])
    score = F.col("score")
    return m.select(F.explode(rows).alias("r")).select("r.*").withColumn("grade", F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").otherwise("D"))


@query("AG23_run_summary", f"{_FILES} SELECT format, count(*) AS n, count(*) FILTER (size >= 50) AS succeeded, count(*) FILTER (size > 0 AND size < 50) AS failed, count(*) FILTER (size = 0) AS skipped, count(*) FILTER (doc_id % 7 = 0) AS scanned, round(avg(size / 100.0::DOUBLE) FILTER (size >= 50), 4) AS mean_seconds FROM files GROUP BY format")
def run_summary(s, d):
    size = F.col("size")
    return files(s, d).groupBy("format").agg(F.count("*").alias("n"), F.count_if(size >= 50).alias("succeeded"), F.count_if((size > 0) & (size < 50)).alias("failed"), F.count_if(size == 0).alias("skipped"), F.count_if(F.col("doc_id") % 7 == 0).alias("scanned"), F.round(F.avg(F.when(size >= 50, size / F.lit(100.0))), 4).alias("mean_seconds"))


@query("AG38_fingerprint", f"{_FILES}, leaves AS (SELECT hash, hash || ':' || count(*) || chr(10) AS leaf FROM files GROUP BY hash), a AS (SELECT substr(hash, 1, 4) AS k, sha256(string_agg(leaf, '' ORDER BY leaf)) AS h FROM leaves GROUP BY ALL), b AS (SELECT substr(k, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM a GROUP BY substr(k, 1, 2)) SELECT sha256(string_agg(h, '' ORDER BY k)) AS fingerprint FROM b")
def fingerprint(s, d):
    """One hash of the whole by a tree of hashes: distinct contents with their counts, then parts of 4 and of 2 digits; each level joins few hashes."""
    leaves = files(s, d).groupBy("hash").agg(F.count("*").alias("n")).select("hash", F.concat("hash", F.lit(":"), F.col("n").cast("string"), F.lit("\n")).alias("h"))
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hash", "h"))), lambda x: x["h"]), ""), 256).alias("h")
    level = leaves
    for digits in (4, 2):
        level = level.groupBy(F.substring("hash", 1, digits).alias("k")).agg(joined()).select(F.col("k").alias("hash"), "h")
    return level.agg(joined()).select(F.col("h").alias("fingerprint"))


@query("JN16_dictionary", "WITH alias(a, canonical) AS (VALUES ('de', 'german'), ('fr', 'french'), ('es', 'spanish')), x AS (SELECT doc_id, lang, lang || '.' AS raw FROM documents) SELECT doc_id, coalesce(e.canonical, p.canonical, raw) AS canonical FROM x LEFT JOIN alias e ON e.a = raw LEFT JOIN alias p ON p.a = regexp_replace(raw, '[^a-z]', '', 'g')")
def dictionary(s, d):
    """Exact alias first, then without punctuation. The dictionary is a fixed list."""
    alias = s.createDataFrame([("de", "german"), ("fr", "french"), ("es", "spanish")], "a string, canonical string")
    rows = read(s, d, "documents").select("doc_id", F.concat("lang", F.lit(".")).alias("raw")).withColumn("bare", F.regexp_replace("raw", "[^a-z]", ""))
    exact, bare = alias.select(F.col("a").alias("raw"), F.col("canonical").alias("x")), alias.select(F.col("a").alias("bare"), F.col("canonical").alias("y"))
    return rows.join(F.broadcast(exact), "raw", "left").join(F.broadcast(bare), "bare", "left").select("doc_id", F.coalesce("x", "y", "raw").alias("canonical"))


@query("DM21_apply_knowledge", "WITH alias(a, canonical) AS (VALUES ('small', 'compact'), ('large', 'grand'), ('promo', 'offer')) SELECT p_partkey, string_agg(DISTINCT coalesce(canonical, w), ',' ORDER BY coalesce(canonical, w)) AS skills FROM (SELECT p_partkey, unnest(string_split(lower(p_type || ' ' || p_name), ' ')) AS w FROM part) LEFT JOIN alias ON a = w GROUP BY p_partkey")
def apply_knowledge(s, d):
    """Names in a profile's list become the dictionary's canonical ones, each once. The dictionary is a fixed list."""
    alias = s.createDataFrame([("small", "compact"), ("large", "grand"), ("promo", "offer")], "w string, canonical string")
    words = read(s, d, "part").select("p_partkey", F.explode(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")).alias("w"))
    return words.join(F.broadcast(alias), "w", "left").groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("canonical", "w"))), ",").alias("skills"))


@query("SRC4_discovery")
def discovery(s, d):
    """Table files below the folder, by name and size; their contents aren't read."""
    found = s.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(d)
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("size"))
