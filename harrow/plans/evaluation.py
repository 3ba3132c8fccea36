"""Evaluation against gold values: field scores, case accuracy, failure modes, thresholds.

Case: order line group (l_orderkey); field: l_returnflag; gold and predicted: l_quantity and l_discount, as whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.plans.registry import query
from harrow.plans.tables import read

_SCORES = """WITH scores AS (SELECT case_id, line, source, field, score, weight, CASE WHEN score >= 85 THEN 'match' WHEN score >= 60 THEN 'partial' WHEN score = 0 THEN 'missing' ELSE 'wrong' END AS verdict
FROM (SELECT l_orderkey AS case_id, l_linenumber AS line, l_suppkey AS source, l_partkey AS part, l_returnflag || l_linestatus AS field, CASE WHEN l_quantity < 3 THEN 0 ELSE least(100, CAST(l_quantity * 2 AS BIGINT) + 10) END AS score, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS weight FROM lineitem))"""


def scores(s, d) -> DataFrame:
    """One row of each case and field: score in per cent, weight, verdict band."""
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    rows = read(s, d, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source"), F.concat("l_returnflag", "l_linestatus").alias("field"),
        F.when(q < 3, 0).otherwise(F.least(F.lit(100), (q * 2).cast("long") + 10)).alias("score"), F.when(flag == "A", 3).when(flag == "N", 2).otherwise(1).alias("weight"),
    )
    x = F.col("score")
    return rows.withColumn("verdict", F.when(x >= 85, "match").when(x >= 60, "partial").when(x == 0, "missing").otherwise("wrong"))


_SIDES = """WITH g AS (SELECT l_orderkey AS case_id, 'k' || l_linenumber AS field, max(l_quantity)::BIGINT AS gold FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), p AS (SELECT l_orderkey AS case_id, 'k' || l_linenumber AS field, min(l_quantity)::BIGINT AS predicted FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
asked AS (SELECT DISTINCT l_orderkey AS case_id, 'k' || l_linenumber AS field FROM lineitem), told AS (SELECT *, CASE WHEN gold IS NULL THEN NULL WHEN predicted IS NULL THEN 0 ELSE greatest(0, 100 - 4 * abs(gold - predicted)) END AS score FROM asked LEFT JOIN g USING (case_id, field) LEFT JOIN p USING (case_id, field)),
judged AS (SELECT *, CASE WHEN gold IS NULL AND predicted IS NULL THEN 'blank_ok' WHEN gold IS NULL THEN 'false_positive' WHEN score >= 85 THEN 'match' WHEN score >= 60 THEN 'partial' ELSE 'miss' END AS verdict FROM told)"""


def judged(s, d) -> DataFrame:
    """(case_id, field, score, verdict) of a gold and a predicted value of each field asked for; either may lack. Without gold nothing is scored."""
    line = read(s, d, "lineitem").withColumn("field", F.concat(F.lit("k"), "l_linenumber")).withColumnRenamed("l_orderkey", "case_id")
    # one pass: each side is an aggregate over its own rows
    sides = line.groupBy("case_id", "field").agg(F.max(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).cast("long").alias("gold"), F.min(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).cast("long").alias("predicted"))
    g, p, x = F.col("gold"), F.col("predicted"), F.col("score")
    rows = sides.withColumn("score", F.when(g.isNull(), None).when(p.isNull(), 0).otherwise(F.greatest(F.lit(0).cast("long"), 100 - 4 * F.abs(g - p))))
    return rows.withColumn("verdict", F.when(g.isNull() & p.isNull(), "blank_ok").when(g.isNull(), "false_positive").when(x >= 85, "match").when(x >= 60, "partial").otherwise("miss"))


@query("AG25_field_rollup", f"{_SIDES} SELECT field, count(score) AS scored, round(avg(score), 4) AS mean, count(*) FILTER (verdict = 'match') AS matched, count(*) FILTER (verdict = 'partial') AS partial, count(*) FILTER (verdict = 'miss') AS missed, count(*) FILTER (score IS NULL) AS blank_gold, count(*) FILTER (verdict = 'false_positive') AS false_positive, CASE WHEN count(*) FILTER (score IS NULL) = 0 THEN 0.0::DOUBLE ELSE round(count(*) FILTER (verdict = 'false_positive')::DOUBLE / count(*) FILTER (score IS NULL), 4) END AS false_positive_rate FROM judged GROUP BY field")
def field_rollup(s, d):
    """Each field's mean score and verdicts; the false-positive rate is that of the rows without a gold value."""
    v, blank = F.col("verdict"), F.count_if(F.col("score").isNull())
    return judged(s, d).groupBy("field").agg(
        F.count("score").alias("scored"), F.round(F.avg("score"), 4).alias("mean"), *[F.count_if(v == x).alias(name) for x, name in (("match", "matched"), ("partial", "partial"), ("miss", "missed"))], blank.alias("blank_gold"), F.count_if(v == "false_positive").alias("false_positive"),
        F.when(blank == 0, 0.0).otherwise(F.round(F.count_if(v == "false_positive") / F.greatest(blank, F.lit(1)), 4)).alias("false_positive_rate"),
    )


_CASES = "cases AS (SELECT case_id, (2 * sum(score * weight) + sum(weight))::BIGINT // (2 * sum(weight))::BIGINT AS accuracy, count(*) AS n, count(*) FILTER (verdict = 'match') AS exact, sum(score)::BIGINT AS total FROM scores GROUP BY case_id)"


def cases(s, d) -> DataFrame:
    """Weighted accuracy of each case, in whole per cent."""
    return scores(s, d).groupBy("case_id").agg(F.expr("(2 * sum(score * weight) + sum(weight)) div (2 * sum(weight))").alias("accuracy"), F.count("*").alias("n"), F.count_if(F.col("verdict") == "match").alias("exact"), F.sum("score").alias("total"))


@query("AG27_case_accuracy", f"{_SCORES}, {_CASES} SELECT case_id, accuracy FROM cases")
def case_accuracy(s, d):
    return cases(s, d).select("case_id", "accuracy")


@query("AG26_summary", f"{_SCORES}, {_CASES} SELECT count(*) AS cases, (2 * sum(accuracy) + count(*))::BIGINT // (2 * count(*)) AS mean_accuracy, sum(n)::BIGINT AS fields, (10000 * sum(exact))::BIGINT // sum(n)::BIGINT AS exact_rate, (2 * sum(total) + sum(n))::BIGINT // (2 * sum(n))::BIGINT AS mean_field FROM cases")
def summary(s, d):
    return cases(s, d).agg(F.count("*").alias("cases"), F.expr("(2 * sum(accuracy) + count(*)) div (2 * count(*))").alias("mean_accuracy"), F.sum("n").alias("fields"), F.expr("(10000 * sum(exact)) div sum(n)").alias("exact_rate"), F.expr("(2 * sum(total) + sum(n)) div (2 * sum(n))").alias("mean_field"))


def examples(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, examples): the n smallest case ids of each group, joined by commas. Cases are made distinct first, and the n are kept while ranking."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("case_id"))
    few = rows.select(*keys, "case_id").distinct().withColumn("k", rank).where(F.col("k") <= n)
    return few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("case_id")), ",").alias("examples"))


def _examples(of: str, keys: str, n: int) -> str:
    return f"(SELECT {keys}, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id) AS examples FROM (SELECT {keys}, case_id, row_number() OVER (PARTITION BY {keys} ORDER BY case_id) AS k FROM (SELECT DISTINCT {keys}, case_id FROM {of})) WHERE k <= {n} GROUP BY {keys})"


@query("AG28_failure_modes", f"{_SCORES}, f AS (SELECT verdict || ':' || field AS mode, * FROM scores WHERE verdict <> 'match'), m AS (SELECT mode, count(*) AS n, sum((100 - score) * weight)::BIGINT AS lost, count(DISTINCT case_id) AS cases FROM f GROUP BY mode) SELECT mode, n, lost, cases, examples, row_number() OVER (ORDER BY lost DESC, mode) AS rank FROM m JOIN {_examples('f', 'mode', 3)} USING (mode)")
def failure_modes(s, d):
    """Modes by weight lost, with three cases of each; there are as many modes as verdicts and fields, so one window ranks them."""
    rows = scores(s, d).where("verdict <> 'match'").withColumn("mode", F.concat_ws(":", "verdict", "field"))
    modes = rows.groupBy("mode").agg(F.count("*").alias("n"), F.sum((100 - F.col("score")) * F.col("weight")).alias("lost"), F.count_distinct("case_id").alias("cases"))
    return modes.join(examples(rows, ["mode"], 3), "mode").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("lost"), "mode")))


@query("AG29_worst_cases", f"{_SCORES}, {_CASES}, worst AS (SELECT case_id, accuracy FROM cases ORDER BY accuracy, case_id LIMIT 20) SELECT case_id, accuracy, string_agg(DISTINCT field, ',' ORDER BY field) FILTER (verdict <> 'match') AS weak FROM worst JOIN scores USING (case_id) GROUP BY ALL")
def worst_cases(s, d):
    worst = cases(s, d).orderBy("accuracy", "case_id").limit(20).select("case_id", "accuracy")
    weak = F.array_join(F.array_sort(F.collect_set(F.when(F.col("verdict") != "match", F.col("field")))), ",")
    return scores(s, d).join(F.broadcast(worst), "case_id").groupBy("case_id", "accuracy").agg(F.nullif(weak, F.lit("")).alias("weak"))  # 20 rows are broadcast


@query("AG30_issue_clusters", f"{_SCORES}, f AS (SELECT field, verdict, CASE weight WHEN 3 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS class, case_id FROM scores WHERE verdict IN ('wrong', 'missing')) SELECT field, verdict, class, cases, examples FROM (SELECT field, verdict, class, count(DISTINCT case_id) AS cases FROM f GROUP BY ALL) JOIN {_examples('f', 'field, verdict, class', 8)} USING (field, verdict, class)")
def issue_clusters(s, d):
    """One vote a case and cluster, with eight cases of each."""
    keys, weight = ["field", "verdict", "class"], F.col("weight")
    rows = scores(s, d).where("verdict in ('wrong', 'missing')").withColumn("class", F.when(weight == 3, "A").when(weight == 2, "B").otherwise("C"))
    return rows.groupBy(*keys).agg(F.count_distinct("case_id").alias("cases")).join(examples(rows, keys, 8), keys)


@query("AG32_verdict_pivot", f"{_SCORES} SELECT field, count(*) FILTER (verdict = 'match') AS pass, count(*) FILTER (verdict IN ('partial', 'wrong')) AS fail, count(*) FILTER (verdict = 'missing') AS absent, (10000 * count(*) FILTER (verdict = 'missing')) // count(*) AS empty_rate, count(DISTINCT case_id) FILTER (weight = 3) AS class_a, count(DISTINCT case_id) FILTER (weight = 2) AS class_b, count(DISTINCT case_id) FILTER (weight = 1) AS class_c FROM scores GROUP BY field")
def verdict_pivot(s, d):
    v = F.col("verdict")
    return scores(s, d).groupBy("field").agg(F.count_if(v == "match").alias("pass"), F.count_if(v.isin("partial", "wrong")).alias("fail"), F.count_if(v == "missing").alias("absent"), F.expr("(10000 * count_if(verdict = 'missing')) div count(*)").alias("empty_rate"), *[F.count_distinct(F.when(F.col("weight") == w, F.col("case_id"))).alias(f"class_{c}") for c, w in (("a", 3), ("b", 2), ("c", 1))])


@query("AG33_signatures", f"{_SCORES}, sig AS (SELECT case_id, string_agg(DISTINCT verdict, '+' ORDER BY verdict) AS signature FROM scores GROUP BY case_id) SELECT signature, n, examples FROM (SELECT signature, count(*) AS n FROM sig GROUP BY signature) JOIN {_examples('sig', 'signature', 10)} USING (signature) ORDER BY n DESC, signature")
def signatures(s, d):
    sig = scores(s, d).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("verdict")), "+").alias("signature"))
    return sig.groupBy("signature").agg(F.count("*").alias("n")).join(examples(sig, ["signature"], 10), "signature").orderBy(F.desc("n"), "signature")


#: Floors of the mean score by field, in per cent.
FLOORS = {"AF": 60, "NF": 65, "NO": 55, "RF": 62}


@query("AG34_thresholds", f"{_SCORES}, floors(field, floor) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in FLOORS.items())}), m AS (SELECT field, sum(score)::BIGINT AS total, count(*) AS n FROM scores WHERE verdict <> 'missing' GROUP BY field) SELECT field, floor::BIGINT AS floor, total // n AS mean, total < floor * n AS violated, CASE WHEN n >= 5 THEN total // n - 2 END AS suggested FROM m JOIN floors USING (field)")
def thresholds(s, d):
    floors = s.createDataFrame(list(FLOORS.items()), "field string, floor long")
    means = scores(s, d).where("verdict <> 'missing'").groupBy("field").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    return means.join(F.broadcast(floors), "field").select("field", "floor", F.expr("total div n").alias("mean"), (F.col("total") < F.col("floor") * F.col("n")).alias("violated"), F.when(F.col("n") >= 5, F.expr("total div n - 2")).alias("suggested"))


@query("JN15_gold_join", "WITH g AS (SELECT l_orderkey AS case_id, 'k' || l_linenumber AS field, max(l_quantity)::BIGINT AS gold FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), p AS (SELECT l_orderkey AS case_id, 'k' || l_linenumber AS field, min(l_quantity)::BIGINT AS predicted FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) SELECT case_id, field, gold, predicted, CASE WHEN gold IS NULL THEN 'false_positive' WHEN predicted IS NULL THEN 'missing' WHEN gold = predicted THEN 'match' ELSE 'wrong' END AS outcome FROM g FULL JOIN p USING (case_id, field)")
def gold_join(s, d):
    """Gold and predicted values side by side by case and field; either may lack."""
    line = read(s, d, "lineitem").withColumn("field", F.concat(F.lit("k"), "l_linenumber")).withColumnRenamed("l_orderkey", "case_id")
    gold = line.where("l_returnflag <> 'R'").groupBy("case_id", "field").agg(F.max("l_quantity").cast("long").alias("gold"))
    made = line.where("l_linestatus = 'F'").groupBy("case_id", "field").agg(F.min("l_quantity").cast("long").alias("predicted"))
    g, p = F.col("gold"), F.col("predicted")
    return gold.join(made, ["case_id", "field"], "full").withColumn("outcome", F.when(g.isNull(), "false_positive").when(p.isNull(), "missing").when(g == p, "match").otherwise("wrong"))


_TRACED = f"{_SIDES}, traced AS (SELECT field, CASE WHEN verdict = 'miss' AND predicted IS NULL THEN 'weak_missing' WHEN verdict = 'false_positive' THEN 'weak_ungrounded' WHEN verdict = 'miss' THEN 'class_b' END AS class, CASE WHEN predicted IS NULL THEN 'no value' WHEN gold IS NULL THEN 'no gold' WHEN abs(gold - predicted) > 20 THEN 'far' WHEN predicted < gold THEN 'low' ELSE 'high' END AS reason FROM judged)"


@query("AG31_backlog", f"{_TRACED}, k AS (SELECT field, class || '/' || reason AS reason, count(*) AS n FROM traced WHERE class IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, reason) AS i FROM k), c AS (SELECT field, count(*) FILTER (class = 'class_b') AS class_b, count(*) FILTER (class = 'weak_missing') AS weak_missing, count(*) FILTER (class = 'weak_ungrounded') AS weak_ungrounded FROM traced WHERE class IS NOT NULL GROUP BY field) SELECT field, class_b, weak_missing, weak_ungrounded, class_b + weak_missing + weak_ungrounded AS impact, string_agg(CASE WHEN i <= 5 THEN reason || ':' || n END, ',' ORDER BY i) AS reasons FROM r JOIN c USING (field) GROUP BY ALL")
def backlog(s, d):
    """Fields by impact: wrong values (class B), values not found and values without ground, with the five most frequent reasons."""
    verdict, g, p = F.col("verdict"), F.col("gold"), F.col("predicted")
    kind = F.when((verdict == "miss") & p.isNull(), "weak_missing").when(verdict == "false_positive", "weak_ungrounded").when(verdict == "miss", "class_b")
    reason = F.when(p.isNull(), "no value").when(g.isNull(), "no gold").when(F.abs(g - p) > 20, "far").when(p < g, "low").otherwise("high")
    counted = judged(s, d).select("field", kind.alias("class"), reason.alias("reason")).where("class is not null").groupBy("field", "class", "reason").agg(F.count("*").alias("n"))
    named = counted.withColumn("reason", F.concat_ws("/", "class", "reason"))
    ranked = named.withColumn("i", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "reason")))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= 5, F.struct("i", F.concat_ws(":", "reason", "n").alias("r"))))), lambda x: x["r"])
    part = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(c)
    return ranked.groupBy("field").agg(part("class_b"), part("weak_missing"), part("weak_ungrounded"), F.sum("n").alias("impact"), F.array_join(top, ",").alias("reasons"))


@query("DM20_diverse_sample", f"{_SCORES}, {_CASES}, l AS (SELECT case_id, accuracy // 10 AS layout FROM cases), r AS (SELECT *, row_number() OVER (PARTITION BY layout ORDER BY case_id) AS k FROM l), a AS (SELECT case_id, layout FROM r WHERE k <= 3), o AS (SELECT case_id, layout, row_number() OVER (PARTITION BY layout ORDER BY case_id) - 1 AS i, count(*) OVER (PARTITION BY layout) AS n FROM l WHERE case_id NOT IN (SELECT case_id FROM a)) SELECT case_id, layout FROM a UNION ALL SELECT case_id, layout FROM o WHERE i % greatest(1, n // 4) = 0 AND i // greatest(1, n // 4) < 4")
def diverse_sample(s, d):
    """The first three cases of each layout class, then four more of it at equal strides."""
    by_class = Window.partitionBy("layout")
    laid = cases(s, d).select("case_id", F.expr("accuracy div 10").alias("layout"))
    ranked = laid.withColumn("k", F.row_number().over(by_class.orderBy("case_id"))).join(laid.groupBy("layout").agg(F.count("*").alias("n")), "layout")
    i, stride = F.col("k") - 4, F.greatest(F.lit(1).cast("long"), F.expr("greatest(n - 3, 0) div 4"))
    spaced = (F.col("k") > 3) & (i % stride == 0) & (i < 4 * stride)
    return ranked.where((F.col("k") <= 3) | spaced).select("case_id", "layout")
