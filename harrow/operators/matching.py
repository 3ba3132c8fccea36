"""Matches between two lists of short texts of a case: skills wanted and found, facts and the rows that may hold them.

A case's texts lie in one row and are compared there, never with another case's: no pair is a row, and no join comes after. Joins that bring a case's
two sides together are by its id and never broadcast: how many texts come out of a row can't be told from the size of a compressed file. What equality,
containment and words leave open goes to Python for its likeness, in Arrow batches.
"""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import text as t
from harrow.functions import values as v

STRONG, LIKE = 0.85, 0.9


@functools.lru_cache(1 << 15)
def _like(x: str, y: str, least: float) -> bool:
    """Bounds on the ratio, from lengths and then from letters, spare most pairs the ratio itself. A worker keeps its latest answers: cases repeat each other's texts."""
    told = difflib.SequenceMatcher(None, x, y)
    return told.real_quick_ratio() >= least and told.quick_ratio() >= least and told.ratio() >= least


def _open(a: str, b: str, least: float) -> bool:
    """The lengths leave a likeness of ``least`` possible."""
    return 2 * min(len(a), len(b)) >= least * (len(a) + len(b))


def alike(asked: Column, others: Column, least: float, turned: bool = False) -> Column:
    """Those of the array ``asked`` whose share of common blocks with one of ``others`` is ``least`` or more; ``turned``: the others come first."""

    @F.pandas_udf("array<string>")
    def found(a: pd.Series, b: pd.Series) -> pd.Series:
        near = lambda x, y: _open(x, y, least) and (_like(y, x, least) if turned else _like(x, y, least))
        return pd.Series([[x for x in xs if any(near(x, y) for y in ys)] for xs, ys in zip(a, b, strict=True)], dtype="object")

    none = F.array().cast("array<string>")
    return found(F.coalesce(asked, none), F.when(F.size(asked) > 0, others).otherwise(none))


def _parts(x: Column) -> Column:
    return F.filter(F.split(x, " +"), lambda w: w != "")


def skill_scores(rows: DataFrame, id: str, gold: str, found: str, *kept: str) -> DataFrame:
    """(id, precision, recall, f1, score, missed, extra, kept ...) of skill cells. A skill is matched by one that is equal, holds it or is held, has all its words
    or none but its, or, from six characters on, is alike by 0.9. Category labels count on the found side only.

    Without skills on both sides all are 1, with none on one side 0; a gold cell without any skill scores 1.
    """

    def held(a: Column, b: Column) -> Column:
        # the words of a single one are within another's only where it is held
        several = a.contains(" ") & b.contains(" ")
        return (a == b) | a.contains(b) | b.contains(a) | (several & (v.within(_parts(a), _parts(b)) | v.within(_parts(b), _parts(a))))

    def open_(p: Column) -> Column:
        return F.struct(p["g"].alias("g"), p["f"].alias("f"), F.filter(p["g"], lambda a: ~F.exists(p["f"], lambda b: held(a, b))).alias("missed"), F.filter(p["f"], lambda b: ~F.exists(p["g"], lambda a: held(a, b))).alias("extra"))

    sides = rows.select(id, *kept, v.let(F.struct(v.split_skills(F.col(gold), True).alias("g"), v.split_skills(F.col(found)).alias("f")), open_).alias("p_"))
    long = lambda c: F.filter(F.col("p_")[c], lambda x: F.length(x) > 5)
    both = sides.select("*", alike(long("missed"), F.col("p_.f"), LIKE).alias("got"), alike(long("extra"), F.col("p_.g"), LIKE, True).alias("wanted"))
    both = both.select(id, *kept, F.size("p_.g").alias("n"), F.size("p_.f").alias("m"), F.array_except("p_.missed", "got").alias("missed"), F.array_except("p_.extra", "wanted").alias("extra"))
    n, m = F.col("n"), F.col("m")
    share = lambda lost, all_: F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(1 - F.size(lost) / F.greatest(all_, F.lit(1)))
    both = both.withColumns({"precision": share("extra", m), "recall": share("missed", n)})
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return both.select(id, "precision", "recall", f1.alias("f1"), F.when(n == 0, 1.0).otherwise(f1).alias("score"), "missed", "extra", *kept)


def stated(rows: DataFrame, name: str, facts: str, texts: str) -> DataFrame:
    """Add ``name``: those of the array ``facts`` that one of ``texts`` states: equal, from six characters on within it or around it, or alike by 0.85.

    Both hold no text twice, no null and none that is empty.
    """

    def compared(p: Column) -> Column:
        alone = F.array_except(p["a"], p["b"])
        outer = F.filter(alone, lambda x: (F.length(x) < 6) | ~F.exists(p["b"], lambda y: x.contains(y) | y.contains(x)))
        return v.let(outer, lambda left: F.when(F.size(left) == 0, left).otherwise(overlapping(left, p["b"])))

    def overlapping(left: Column, b: Column) -> Column:
        """Those of ``left`` whose tokens are no other's."""
        tokened = lambda xs: F.transform(xs, lambda x: F.struct(x.alias("x"), t.tokens(x).alias("t")))
        return v.let(tokened(b), lambda others: F.transform(F.filter(tokened(left), lambda q: ~F.exists(others, lambda o: t.token_f1(q["t"], o["t"]) >= STRONG)), lambda q: q["x"]))

    # most facts are told word for word, and most others within one or around it; likeness is left with what no text of the case decides
    left = rows.withColumn("left_", v.let(F.struct(F.col(facts).alias("a"), F.col(texts).alias("b")), compared))
    liked = left.withColumn("liked_", alike(F.col("left_"), F.col(texts), STRONG))
    return liked.withColumn(name, F.array_except(facts, F.array_except("left_", "liked_"))).drop("left_", "liked_")


def _distinct(texts: Column) -> Column:
    return F.filter(F.array_distinct(texts), lambda x: x != "")


def fact_hits(facts: DataFrame, texts: DataFrame, id: str) -> DataFrame:
    """(id, a): the facts of ``facts(id, a)`` that a text of ``texts(id, b)`` states (see ``stated``)."""
    one = lambda rows, c: rows.groupBy(id).agg(_distinct(F.collect_set(c)).alias(c))
    # outer: no filter on the hits is drawn, which would need Python
    return stated(one(facts, "a").join(one(texts, "b").hint("merge"), id), "hits", "a", "b").select(id, F.explode_outer("hits").alias("a")).where("a IS NOT NULL")


def section_scores(gold: DataFrame, found: DataFrame, id: str) -> DataFrame:
    """(id, recall, precision, f1, date_recall, score, tags) of a repeating section.

    ``gold(id, entry, facts array, years array)`` and ``found(id, entry, strings array, text, years array)``. Recall is the share of gold facts that a found string
    states, precision that of found rows which state a fact or have 60 % of their tokens in the gold entries. Rows may be split or merged
    otherwise. Without gold facts the score is 0, without found strings too. Each side is read once, and a case's rows become one.
    """
    years = lambda name: F.array_distinct(F.flatten(F.collect_set("years"))).alias(name)
    listed = gold.groupBy(id).agg(F.flatten(F.collect_list("facts")).alias("facts"), years("years"), F.count("*").alias("entries"))
    seen = found.groupBy(id).agg(F.flatten(F.collect_set("strings")).alias("stated_"), F.collect_list("text").alias("texts"), years("found_years"), F.sum(F.size("strings")).alias("strings"), F.count("*").alias("rows"))
    none, zero = F.array().cast("array<string>"), lambda c: F.coalesce(F.col(c), F.lit(0))
    both = listed.join(seen.hint("merge"), id, "left").withColumns({c: F.coalesce(c, none) for c in ("stated_", "texts", "found_years")})
    both = both.withColumns({"facts_": _distinct(F.col("facts")), "stated_": _distinct(F.col("stated_")), "texts_": _distinct(F.col("texts"))})
    both = stated(stated(both, "hit", "facts_", "stated_"), "backed", "texts_", "facts_")

    def spurious(p: Column) -> Column:
        return F.size(F.filter(p["texts"], lambda x: (x == "") | ~(F.array_contains(p["backed"], x) | (t.containment(t.tokens(x), p["blob"]) >= 0.6))))

    whole = F.struct("texts", "backed", t.tokens(F.array_join("facts_", " ")).alias("blob"))
    all_ = both.withColumns({"n": F.size("facts"), "hits": v.let(F.struct("facts", "hit"), lambda p: F.size(F.filter(p["facts"], lambda x: F.array_contains(p["hit"], x)))), "spurious": v.let(whole, spurious)})
    ok = (F.col("n") > 0) & (zero("strings") > 0)
    recall = F.when(ok, F.col("hits") / F.greatest(F.col("n"), F.lit(1))).otherwise(0.0)
    precision = F.when(ok, 1 - F.col("spurious") / F.greatest(zero("rows"), F.lit(1))).otherwise(0.0)
    dates = F.when(F.size("years") == 0, 1.0).otherwise(F.size(F.array_intersect("years", "found_years")) / F.greatest(F.size("years"), F.lit(1)))
    all_ = all_.withColumns({"recall": recall, "precision": precision, "date_recall": F.when(ok, dates).otherwise(0.0)})
    p, r = F.col("precision"), F.col("recall")
    all_ = all_.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
    score = F.when(ok, F.least(F.lit(1.0), 0.65 * F.col("f1") + 0.2 * r + 0.15 * F.col("date_recall"))).otherwise(0.0)
    delta = zero("rows") - F.col("entries")
    tags = F.array_compact(F.array(
        F.when((F.col("n") > 0) & ~ok, "not_extracted"), F.when(ok & (r < 0.7), "low_fact_recall"), F.when(ok & (p < 0.7), "spurious_rows"), F.when(ok & (F.size("years") > 0) & (F.col("date_recall") < 0.5), "dates_missing"),
        F.when(ok & (delta <= -1) & (F.col("entries") > 1), "rows_merged"), F.when(ok & (delta >= 2), "rows_split"),
    ))
    return all_.select(id, "recall", "precision", "f1", "date_recall", score.alias("score"), tags.alias("tags"))


def phrase_hits(texts: DataFrame, phrases: DataFrame, id: str, longest: int) -> DataFrame:
    """(id, phrase): the phrases of ``phrases(phrase)`` that stand in ``texts(id, text)`` as whole tokens.

    Texts and phrases become tokens (letters, digits, + and #, in lower case); a text's runs of up to ``longest`` tokens that begin like a phrase are joined with the phrases
    by equality, so java is not found in javascript, and phrases of several words are. No text is compared with a phrase that it doesn't hold.
    A text's equal runs count once.
    """
    token = lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9+#]+"), lambda w: w != "")
    wanted = phrases.select("phrase", token(F.col("phrase")).alias("w")).where(F.size("w").between(1, longest)).select("phrase", F.array_join("w", " ").alias("run"), F.get("w", F.lit(0)).alias("first"), F.size("w").alias("n")).distinct()
    words, w = texts.select(id, token(F.col("text")).alias("w")), F.col("w")
    # outer: no filter on the tokens is drawn that takes them apart again; token by token, as a slice would copy the whole text's tokens each time
    ahead = words.select(id, F.explode_outer(F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array(*[F.get(w, i + k) for k in range(longest)])))).alias("s"))
    begun = ahead.withColumn("first", F.get("s", F.lit(0))).join(wanted.select("first", "n").distinct(), "first").where(F.get("s", F.col("n") - 1).isNotNull())
    runs = begun.select(id, F.array_join(F.slice("s", F.lit(1), F.col("n")), " ").alias("run"))
    return runs.join(wanted.select("run", "phrase"), "run").select(id, "phrase").distinct()


def contained(left: DataFrame, right: DataFrame, gram: int = 3) -> DataFrame:
    """Pairs of ``left(a, ...)`` and ``right(b, ...)`` one of whose names is within the other, or equal; empty names match nothing.

    A prefix filter: of the name that is to be within the other, the rarest of its runs of ``gram`` characters is the key, and the other's runs are
    joined with it by equality; the containment itself is a residual. Names shorter than that are keyed by themselves at their own length.
    """
    names = lambda rows, c: rows.where(F.col(c) != "")
    left, right = names(left, "a"), names(right, "b")

    def runs(x: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n))))

    def inside(needles: DataFrame, c: str, hay: DataFrame, h: str) -> DataFrame:
        distinct_needles, distinct_hay = needles.select(c).distinct(), hay.select(h).distinct()
        told = []
        for n in range(1, gram + 1):
            fits = F.length(c) == n if n < gram else F.length(c) >= gram
            keyed = distinct_hay.where(F.length(h) >= n).select(h, F.explode(runs(F.col(h), n)).alias("key"))
            usual = keyed.groupBy("key").agg(F.count("*").alias("often"))
            mine = distinct_needles.where(fits).select(c, F.explode(runs(F.col(c), n)).alias("key")).join(usual, "key", "left")
            rarest = mine.groupBy(c).agg(F.min(F.struct(F.coalesce("often", F.lit(0)), "key")).alias("k")).select(c, F.col("k.key").alias("key"))
            told.append(rarest.join(keyed, "key").where(F.col(h).contains(F.col(c))).select(c, h))
        out = told[0]
        for more in told[1:]:
            out = out.unionByName(more)
        return out

    pairs = inside(left, "a", right, "b").unionByName(inside(right, "b", left, "a").select("a", "b")).distinct()
    return left.join(pairs, "a").join(right, "b")
