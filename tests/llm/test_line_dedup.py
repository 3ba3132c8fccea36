"""Line de-duplication against exact Jaccard similarity of all pairs of lines."""

import random
import re

from pyspark.sql import functions as F

from harrow.llm import line_dedup


def shingle_set(line):
    return {line[i : i + 7] for i in range(max(1, len(line) - 6))}


def brute(rows):
    """rows: (doc_id, text) of distinct ids. The texts left when one line stays of each component of similar lines."""
    first = {}
    for k, text in sorted(rows):
        for pos, line in enumerate(text.split("\n")):
            if re.search(r"[^ \t\n\x0b\f\r]", line):
                first.setdefault(line, (k, pos))
    lines = list(first)
    sets = [shingle_set(x) for x in lines]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    up = list(range(len(lines)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    kept = {min(first[lines[j]] for j in group) for group in groups(root, len(lines)).values()}
    return {k: "\n".join(x for pos, x in enumerate(text.split("\n")) if (k, pos) in kept or not re.search(r"[^ \t\n\x0b\f\r]", x)) for k, text in rows}


def groups(root, n):
    out = {}
    for i in range(n):
        out.setdefault(root(i), []).append(i)
    return out


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(docs).collect()}
    assert got.keys() == want.keys()
    lines = lambda t: set(t.split("\n"))
    # soundness: nothing goes that the exact version keeps; recall: banding may miss few
    assert all(lines(want[k]) <= lines(got[k]) for k in want)
    over = sum(len(lines(got[k]) - lines(want[k])) for k in want)
    gone = sum(len(t.split("\n")) for t in (r.text for r in docs.collect())) - sum(len(t.split("\n")) for t in want.values())
    assert over <= 0.01 * gone


def test_similar_lines(spark):
    line = "the committee met on tuesday to review all of the open applications for the regional office before the summer"
    changed = line.replace("summer", "winter")
    rows = [(3, f"{line}\nunique first line of this document"), (1, f"keep me\n\n{changed}\nkeep me"), (2, f"{line}\n{line} too")]
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: f"keep me\n\n{changed}", 2: "", 3: "unique first line of this document"}


def test_large_group_of_similar_lines(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:i % 50], f"x{i}", *words[i % 50 + 1 :]])) for i in range(400)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)


def test_shingles_from_every_character(spark):
    rng = random.Random(3)
    lines = ["short", "sevench", "🙂你好" * 9, *("".join(rng.choice("ab é你🙂") for _ in range(n)) for n in (*range(1, 12), *range(30, 48), 70, 71, 500))]
    wide = spark.createDataFrame(list(enumerate(lines)), "k int, line string").select("k", line_dedup.wide(F.col("line")).alias("w"))
    pairs = spark.createDataFrame([(k, s) for k, x in enumerate(lines) for s in shingle_set(x)], "k int, s string")
    want = {r.k: set(r.s) for r in pairs.select("k", line_dedup.wide(F.col("s")).alias("w")).groupBy("k").agg(F.collect_set(F.xxhash64("w")).alias("s")).collect()}
    assert want == {r.k: set(r.s) for r in line_dedup.exploded(wide, "k").groupBy("k").agg(F.collect_set("s").alias("s")).collect()}
    flat = line_dedup.strips(wide, "k").select("k", F.explode(F.array(*[f"s{j}" for j in range(line_dedup.WIDTH)])).alias("s"))
    assert want == {r.k: set(r.s) for r in flat.groupBy("k").agg(F.collect_set("s").alias("s")).collect()}


def test_recall_of_similar_lines_by_size(spark):
    """Pairs of lines that are similar and not equal share a band: 99 % of them, whatever their length."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz ,."
    texts, pairs = [], []
    for size in (11, 13, 16, 20, 30, 60, 120, 400):
        while sum(p[2] == size for p in pairs) < 150:
            line = "".join(rng.choice(letters) for _ in range(size))
            at = rng.randrange(size + 1)
            other = rng.choice([line + rng.choice(letters), rng.choice(letters) + line, line[:-1], line[:at] + rng.choice(letters) + line[at:]])
            a, b = shingle_set(line), shingle_set(other)
            if line.strip() and other.strip() and line != other and len(a & b) >= 0.8 * len(a | b):
                pairs.append((len(texts), len(texts) + 1, size))
                texts += [line, other]
    rows = spark.createDataFrame([(i, None, 0, i, 0, t) for i, t in enumerate(texts)], "id bigint, mark bigint, pos int, h bigint, g bigint, line string").fillna(0)
    bands = {r.h: set(r.bands) for r in line_dedup.signatures(rows).collect()}
    met = {size: sum(bool(bands[a] & bands[b]) for a, b, s in pairs if s == size) for size in {p[2] for p in pairs}}
    assert sum(met.values()) >= 0.99 * len(pairs) and all(n >= 0.95 * 150 for n in met.values()), met


def test_lines_that_differ_in_word_tails_stay(spark):
    texts = ["Order number 1234567890123 shipped", "Order number 1234567987654 shipped", "contact@example.org", "contact@elsewhere.net", "我们今天在北京开会讨论新的项目计划", "我们今天在北京参观博物馆和历史遗迹"]
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(texts))


def test_clashing_names_and_other_ids(spark):
    line = "a line that occurs in more than one of the documents of this test"
    rows = [("b", f"{line}\nsecond", 1, 2, 3, 4, 5), ("a", line, 1, 2, 3, 4, 5), (None, None, 1, 2, 3, 4, 5), ("b", "", 1, 2, 3, 4, 5)]
    names = ["_id", "_mark", "_kept", "_lines", "kept"]
    frame = spark.createDataFrame(rows, "doc_id string, text string, _id int, _mark int, _kept int, _lines int, kept int")
    got = line_dedup.deduplicate_lines(frame)
    assert got.columns == frame.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("b", "second", 1, 2, 3, 4, 5), ("a", line, 1, 2, 3, 4, 5), (None, None, 1, 2, 3, 4, 5), ("b", "", 1, 2, 3, 4, 5)]))
    assert got.select(*names).distinct().count() == 1


def test_hot_bands_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "FEW", 8)
    monkeypatch.setattr(line_dedup, "MORE", 4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 50], f"x{i % 90}", *words[i % 50 + 1 :]])) for i in range(150)]
    rows += [(200 + i, f"the same beginning of a line that many lines have, and then {i} " + f"{i * 7919 % 1000} " * 6) for i in range(100)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute(rows)
    assert sum(got[k] != want[k] for k in want) <= 2


def test_pairs_that_are_not_similar_are_ruled_out_by_their_sketches(spark, monkeypatch):
    """Long lines of one bucket at a similarity of some 0.6, and few that are similar: next to no other pair is left to verify."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(100)]
    texts = [" ".join(word() if rng.random() < 0.08 else w for w in base) for _ in range(40)]
    rows = list(enumerate([*texts, *(f"{x} end" for x in texts[:5])]))
    met, real = [], line_dedup.similar

    def counted(pairs, texts):
        met.append(pairs.count())
        return real(pairs, texts)

    monkeypatch.setattr(line_dedup, "similar", counted)
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows)
    assert 5 <= sum(met) <= 24, met


def test_shingles_that_repeat_within_a_line(spark):
    """Similarity goes by distinct shingles: lines of one phrase, repeated more or less often, are similar."""
    rows = [(k, "all of it again and " * n) for k, n in enumerate((3, 4, 7, 10, 40))] + [(9, "none of it at all, ever, " * 5), (10, "none of it at all, ever, " * 12)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows) and sum(map(bool, got.values())) == 2


def test_common_shingles_are_counted_once(spark):
    """The exact comparison takes the numbers of distinct shingles from the pair: repeats within a line count for nothing."""
    lines = ["all of it again and " * 3, "all of it again and " * 40, "all of it, again and again, " * 3, "short", "short one"]
    sets = [shingle_set(x) for x in lines]
    texts = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    pairs = [(a, b, len(sets[a]) + len(sets[b])) for b in range(len(lines)) for a in range(b)]
    got = {(r.a, r.b) for r in line_dedup.similar(spark.createDataFrame(pairs, "a long, b long, sum long"), texts).collect()}
    assert got == {(a, b) for a, b, _ in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])} and (0, 1) in got
    sizes = {r.n: r.size for r in line_dedup.sketches(texts).select("n", "size").collect()}
    assert sizes == {n: len(x) for n, x in enumerate(sets)}


def test_shingles_are_told_apart_in_compiled_code_and_no_pattern_reads_a_whole_text(spark, odd_documents):
    wide = spark.createDataFrame([(1, "a line of some length")], "k int, line string").select("k", line_dedup.wide(F.col("line")).alias("w"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    generators = [x for x in plan(line_dedup.exploded(wide, "k")).split("\n") if "Generate" in x]
    assert generators and not any("array_distinct" in x for x in generators)
    assert " + " not in plan(line_dedup.strips(wide, "k"))
    assert not re.search(r"text#\d+ RLIKE", plan(line_dedup.line_digests(odd_documents)))


def test_odd_documents(odd_documents, no_documents):
    out = line_dedup.deduplicate_lines(odd_documents)
    assert out.columns == odd_documents.columns
    got = out.collect()
    assert len(got) == odd_documents.count()
    text = {r.doc_id: r.text for r in got if r.doc_id not in (None, 5, 6)}
    assert text[0] is None and text[1] == "" and text[3] == "\n\n" and text[4] == "one"
    assert [r.text for r in got if r.doc_id == 5] == ["Hello, wörld! 你好 🙂"] * 3
    assert line_dedup.deduplicate_lines(no_documents).count() == 0
    digests = line_dedup.line_digests(odd_documents)
    assert digests.where("doc_id = 0").select("n_lines", "n_kept").first() == (0, 0)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
