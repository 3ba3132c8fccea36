"""Line de-duplication: one line stays of every group of equal or similar lines. DataFrame functions only.

A line's shingles are the SHINGLE characters from every character that has as many left; a shorter line is its own shingle. MinHash:
each of BANDS x ROWS permutations of the shingle hashes, by rotation and XOR, gives the line its least one; ROWS of them make a
band key. Lines that share a band key meet in a bucket, where leaders are
verified against the others by exact Jaccard similarity (in a small bucket, all lines against each other); distributed union-find joins
the verified links, until no two lines of a bucket are in different components unverified. A sketch of each line's distinct shingles, their
parities by bits, leaves hardly any pair to verify that isn't similar, and rules no true one out. Each component keeps its first line.
"""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, fresh, settle

#: Jaccard similarity of similar lines; bands and rows find a pair at the threshold with 99.5 %.
SIMILARITY, SHINGLE, BANDS, ROWS = 0.8, 7, 10, 4
#: A bucket of so many lines at most is small.
SMALL = 8
#: Leaders of a larger bucket grow by this factor from round to round.
MORE = 8
#: Columns of a line's sketch, 64 bits each: a power of two of them.
SKETCH = tuple(f"w{k}" for k in range(16))
#: Shingles of a line that one row takes in when they are reduced to minima: a power of two.
WIDTH = 32
#: A band that holds more than one in so many of all rows (and FEW rows) is hot: its rows are dealt in parts. There are ROWS-many times fewer of them.
SHARE, FEW = 1000, 256
#: A line's identity: 128 bits of two hashes, of which 10^12 lines share one with a chance of 10^-15.
IDENTITY = ("h", "g")
#: The place of a line's first occurrence.
PLACE = ("id", "mark", "pos")


def wide(line: Column) -> Column:
    """The line in four bytes a character, so that characters are found by their place."""
    return F.encode(line, "UTF-32")


def exploded(lines: DataFrame, *names: str) -> DataFrame:
    """The named columns and the hash s of every distinct shingle of every line ``w`` (wide and not empty)."""
    # told apart in a projection of its own, where Spark compiles it; a generator's argument is interpreted
    return lines.select(*names, F.array_distinct(shingles(F.col("w"))).alias("s")).select(*names, F.explode("s").alias("s"))


def strips(lines: DataFrame, *names: str) -> DataFrame:
    """The named columns and the hashes s0, s1, ... of WIDTH shingles on from each WIDTH-th of every line ``w``; the last one fills up a line's last row."""
    last = F.greatest(F.length("w") - (4 * SHINGLE - 1), F.lit(1))
    rows = lines.select(*names, "w", last.alias("last"), F.explode(F.sequence(F.lit(0), last - 1, F.lit(4 * WIDTH))).alias("i"))
    # i is a multiple of 4 * WIDTH, a power of two: | adds without a check for overflow
    return rows.select(*names, *[F.expr(f"xxhash64(substring(w, least(i | {4 * j + 1}, last), {4 * SHINGLE}))").alias(f"s{j}") for j in range(WIDTH)])


def permuted(s: str, k: int) -> str:
    """The k-th permutation of a 64-bit hash, in SQL."""
    turn, key = (37 * k + 5) % 63 + 1, (k + 1) * 0x9E3779B97F4A7C15 % (1 << 63)
    return f"((shiftleft({s}, {turn}) | shiftrightunsigned({s}, {64 - turn})) ^ {key}L)"


def document_key(documents: DataFrame) -> list[Column]:
    """id and mark, the text's hash: they name a document. Null ids come before all others."""
    whole = documents.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return [known.alias("id"), F.xxhash64("text").alias("mark")]


def lines_of(documents: DataFrame) -> DataFrame:
    """(id, mark, pos, h, g, line) of all lines that aren't blank."""
    rows = documents.where("text is not null").select(*document_key(documents), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"\S")).select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def signatures(lines: DataFrame) -> DataFrame:
    """(h, g, id, mark, pos, bands) of each distinct line, at the place where it occurs first."""
    distinct = lines.groupBy(*IDENTITY).agg(F.first("line").alias("line"), F.min(F.struct(*PLACE)).alias("first"))
    keys = (*IDENTITY, *PLACE)
    rows = strips(distinct.select(*IDENTITY, "first.*", wide(F.col("line")).alias("w")), *keys)
    # the rows of a line are together since the grouping by its identity: no shuffle here
    least = rows.groupBy(*keys).agg(*[F.expr(f"min(least({', '.join(permuted(f's{j}', k) for j in range(WIDTH))}))").alias(f"m{k}") for k in range(BANDS * ROWS)])
    bands = [F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return least.select(*keys, F.array(*bands).alias("bands"))


def sketches(texts: DataFrame) -> DataFrame:
    """(n, size, w0, w1, ...) of each line (n, line): the number of its distinct shingles and, by bits, the parities of how many of them fall on each."""
    bit, word = F.expr("shiftleft(1L, cast(s & 63 as int))"), F.shiftrightunsigned("s", 6).bitwiseAND(F.lit(len(SKETCH) - 1))
    parities = [F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("long")).alias(w) for k, w in enumerate(SKETCH)]
    return exploded(texts.select("n", wide(F.col("line")).alias("w")), "n").groupBy("n").agg(F.count("*").alias("size"), *parities)


def close(size: Column, words: list[Column], other: Column, others: list[Column]) -> Column:
    """Whether two sketches leave it open that their lines are similar.

    |A xor B| is at least the number of differing parities, and at most (1 - t) / (1 + t) (|A| + |B|) at similarity t; the sizes' ratio is at least t.
    """
    differing = sum((F.bit_count(w.bitwiseXOR(x)) for w, x in zip(words, others, strict=True)), F.lit(0))
    return (F.least(size, other) >= SIMILARITY * F.greatest(size, other) - 1e-6) & (differing * (1 + SIMILARITY) <= (size + other) * (1 - SIMILARITY) + 1e-6)


def shingles(w: Column) -> Column:
    """The hashes of the shingles of a wide line, repeats included."""

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * SHINGLE))))

    return F.get(F.transform(F.array(w), hashes), F.lit(0))


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of pairs (a, b, sum, ...), distinct by a and b, whose lines' exact Jaccard similarity reaches the threshold; texts: (n, line).

    sum: the numbers of the two lines' distinct shingles, as their sketches have them. A pair is compared where its two lines meet:
    a task holds two lines' shingles at a time, however many pairs it gets.
    """
    met = pairs.join(texts.select(F.col("n").alias("a"), F.col("line").alias("x_")), "a").join(texts.select(F.col("n").alias("b"), F.col("line").alias("y_")), "b")
    # array_intersect gives each common shingle once
    shared = met.select(*pairs.columns, F.size(F.array_intersect(shingles(wide(F.col("x_"))), shingles(wide(F.col("y_"))))).alias("both_"))
    return shared.where(F.col("both_") >= SIMILARITY * (F.col("sum") - F.col("both_"))).select(*pairs.columns)


def buckets(signed: DataFrame) -> DataFrame:
    """(band, part, parts, n, leader, small) for each line of a band that several lines have; leader: the smallest n among them.

    A hot band's rows are dealt in parts; at most SHARE bands are hot, whatever the corpus.
    """
    rows = signed.select("n", F.explode("bands").alias("band"))
    crowded = settle(rows.groupBy("band").agg(F.count("*").alias("count"), F.min("n").alias("leader")).where("count > 1"), "crowded")
    total = crowded.agg(F.sum("count")).first()[0] or 0
    fair = max(FEW, -(-total // SHARE))
    parts = crowded.withColumn("parts", F.ceil(F.col("count") / fair).cast("long"))
    hot = parts.where("parts > 1").select("band", "parts")
    dealt = rows.join(F.broadcast(hot), "band", "left").select("n", "band", F.pmod(F.xxhash64("n"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part"))
    owned = parts.select("band", "parts", "leader", (F.col("count") <= min(SMALL, fair)).alias("small"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    out = settle(dealt.join(owned, ["band", "part"]).select("band", "part", "parts", "n", "leader", "small"), "buckets")
    discard(crowded)
    collected(signed)
    return out


def texts_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(n, line) of the lines at the places ``wanted`` (n, id, mark, pos): a document that holds some is split once."""
    places = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("pos", "n")).alias("places"))
    held = documents.where("text is not null").select(*document_key(documents), "text").join(places, ["id", "mark"])
    lines = held.select("places", F.split("text", "\n").alias("lines"))
    found = lines.select(F.explode(F.transform("places", lambda p: F.struct(p["n"].alias("n"), F.get("lines", p["pos"]).alias("line")))).alias("l")).select("l.*")
    # rows that repeat a document give its lines again
    return found.groupBy("n").agg(F.first("line").alias("line"))


def similar_groups(documents: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, component) of the lines n that have others in a bucket: the groups of similar lines.

    First, all lines of a small bucket are verified against each other, and those of a larger one against its leader. In each round on, larger
    buckets name more leaders (up to MORE times as many in each round), and their lines of other
    components are verified against them; a leader then leaves the bucket. Leaders are lines outside the largest component of what
    the bucket still holds: a bucket is done when it holds one component, as all pairs across components are verified then.
    Union-find runs over the round's links between the components that there were, never over earlier ones again.
    """
    bucket = buckets(signed)
    wanted = bucket.select("n").distinct().join(signed.select("n", *PLACE), "n")
    texts = settle(texts_of(documents, wanted), "texts")
    sketched = settle(sketches(texts), "sketches")
    del wanted
    collected(signed)
    here, there = [F.col(w) for w in SKETCH], [F.col(f"l{w}") for w in SKETCH]
    near = close(F.col("size"), here, F.col("lsize"), there)
    other = [F.col(x).alias(f"l{x}") for x in ("size", *SKETCH)]
    small, large = bucket.where("small"), bucket.where("not small")
    each = small.select("band", F.col("n").alias("leader")).join(small.select("band", "n"), "band").where("leader < n")
    first = each.select("leader", "n").unionByName(large.where("n <> leader").select("leader", "n")).distinct()
    met = first.join(sketched.select(F.col("n").alias("leader"), *other), "leader").join(sketched, "n").where(near)
    both = (F.col("size") + F.col("lsize")).alias("sum")
    pairs = met.select(F.col("leader").alias("a"), F.col("n").alias("b"), both, F.col("leader").alias("ca"), F.col("n").alias("cb"))
    held = large.where("n <> leader").select("band", "part", "parts", "n").join(sketched, "n").withColumn("c", F.col("n"))
    steps, most, leaders = [], 1, None
    while True:
        links = settle(similar(pairs, texts).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")
        step = components(links, "lines")
        steps.append(step)
        discard(links)
        del pairs, met
        collected(signed)
        left_over = held if leaders is None else held.join(leaders.select("band", F.col("leader").alias("n")), ["band", "n"], "left_anti")
        renamed = step.select(F.col("node").alias("c"), "component")
        labelled = settle(left_over.join(renamed, "c", "left").select(F.coalesce("component", "c").alias("c"), *[x for x in left_over.columns if x != "c"]), "held")
        if leaders is not None:
            discard(leaders), discard(held)
        # a hot band's rows are counted part by part first
        largest = labelled.groupBy("band", "c").count().groupBy("band").agg(F.max(F.struct("count", "c")).alias("top"), F.count("*").alias("many")).where("many > 1").select("band", F.col("top.c").alias("top"))
        held = settle(labelled.join(largest, "band"), "held")
        discard(labelled)
        open_, most = held.where("c <> top"), most * MORE
        if not open_.limit(1).count():
            break
        slot = F.pmod(F.xxhash64("n", F.lit(most)), F.lit(most)).alias("slot")
        named = open_.groupBy("band", slot).agg(F.min(F.struct("n", "c", "parts", "size", *SKETCH)).alias("l"))
        leaders = settle(named.select("band", F.col("l.n").alias("leader"), F.col("l.c").alias("of"), F.col("l.parts").alias("parts"), *[F.col(f"l.{x}").alias(f"l{x}") for x in ("size", *SKETCH)]), "leaders")
        every = leaders.select("*", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part")).drop("parts")
        held = held.drop("top")
        met = held.join(every, ["band", "part"]).where("c <> of").where(near)
        pairs = met.select(F.col("leader").alias("a"), F.col("n").alias("b"), both, F.col("of").alias("ca"), F.col("c").alias("cb")).distinct()
    label = texts.select(F.col("n").alias("node"), F.col("n").alias("c"))
    for step in steps:
        renamed = step.select(F.col("node").alias("c"), "component")
        label = label.join(renamed, "c", "left").select("node", F.coalesce("component", "c").alias("c"))
    label = settle(label.select("node", F.col("c").alias("component")), "groups")
    for done in (held, texts, sketched, bucket, leaders, *steps):
        discard(done)
    return label


def kept_lines(documents: DataFrame) -> DataFrame:
    """(id, mark, pos): the one line that stays of every group of similar lines."""
    signed = settle(signatures(lines_of(documents)).withColumn("n", F.monotonically_increasing_id()), "signatures")
    collected(documents)
    label = similar_groups(documents, signed)
    # a line that met no other is its component
    group = signed.select(F.struct(*PLACE).alias("first"), F.col("n").alias("node")).join(label, "node", "left").select("first", F.coalesce("component", "node").alias("c"))
    kept = settle(group.groupBy("c").agg(F.min("first").alias("first")).select("first.*"), "kept")
    discard(signed), discard(label)
    collected(documents)
    return kept


def collected(documents: DataFrame) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are settled."""
    gc.collect()
    documents.sparkSession._jvm.System.gc()


def deduplicate_lines(documents: DataFrame) -> DataFrame:
    """The documents with their own columns; ``text`` loses every line that an earlier one repeats or resembles.

    The first of similar lines, by (doc_id, line number), stays where it is; null ids come before all others, and ids that aren't whole
    numbers are ordered as text. Blank lines stay. A null text stays null. Rows that repeat both doc_id and text are one
    document and keep the same lines. A document may become empty; it stays. An empty table gives no rows. A column n_chars,
    if there is one, is not recomputed; columns of any other name stay as they are.
    """
    kept, id_, mark_, lines = (fresh(documents, x) for x in ("kept", "id", "mark", "lines"))
    positions = kept_lines(documents).groupBy("id", "mark").agg(F.sort_array(F.collect_list("pos")).alias(kept))
    named = positions.select(F.col("id").alias(id_), F.col("mark").alias(mark_), kept)
    ids, mark = document_key(documents)
    joined = documents.join(named, (ids == F.col(id_)) & (mark == F.col(mark_)), "left").withColumn(lines, F.split("text", "\n"))
    stays = F.coalesce(kept, F.array().cast("array<int>"))
    # blank lines stay: each line is looked at up to its first other character, where a pattern over the whole text reads all of it
    blank = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(r"\S"), i)), lambda p: p.isNotNull())
    stay = F.array_sort(F.concat(stays, blank))
    chosen = F.array_join(F.transform(stay, lambda p: F.get(F.col(lines), p)), "\n")
    whole = F.col("text").isNull() | (F.size(lines) == F.size(stays))
    return joined.select(*[F.when(whole, F.col("text")).otherwise(chosen).alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])


def line_digests(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_kept, text_sha256) of every document after line de-duplication; a null or empty text has no lines."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    count = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(breaks + 1).cast("long")
    after = deduplicate_lines(documents.select("doc_id", "text", count.alias("n_lines")))
    return after.select("doc_id", "n_lines", count.alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
