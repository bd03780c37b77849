import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemlab.coefficients import Coefficients
from itemlab.functions import stats, text, vectors
from itemlab.operators import alignment, criteria, dashboards, duplicates, imports, items, paging, reliability, rules, search, store, students

FACTS = "import_id int, student_id long, question_id long, received_score double, discipline_name string"


def facts(spark, rows):
    return spark.createDataFrame([(*r, "d") for r in rows], FACTS)


def questions(spark, rows):
    return spark.createDataFrame(rows, "question_id long, max_score double, question_text string, syllabus_topic_id int")


def by(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}


def test_item_quality(spark):
    rows = facts(spark, [(1, 1, 1, 80.0), (1, 1, 2, 30.0), (1, 1, 3, 60.0), (1, 2, 3, None), (1, 3, 3, 59.0), (1, 1, 4, 50.0), (2, 1, 1, 0.0)])
    qs = questions(spark, [(1, 100.0, "a", 1), (2, 0.0, "b", 1), (3, None, "c", None)])
    got = by(items.item_quality(rows, qs).collect(), "import_id", "question_id")
    assert [got[1, k].flag for k in (1, 2, 3, 4)] == ["too_easy", "too_hard", "normal", "normal"]
    assert (got[1, 3].n, got[1, 3].p_correct, got[1, 3].mean_score, got[1, 3].std_score) == (2, 0.5, 59.5, 0.71)
    assert got[1, 1].std_score == 0.0 and got[2, 1].difficulty_pct == 100.0


def test_correlation_guards(spark):
    rows = [(1, s, 1, float(s)) for s in range(3)] + [(1, s, 2, 5.0) for s in range(6)] + [(1, s, 3, 10.0 * s) for s in range(6)]
    rows += [(1, s, 4, 10.0 * s) for s in range(6)]
    got = by(items.item_total_correlation(facts(spark, rows)).collect(), "question_id")
    assert got[1].r == 0.0 and got[2].r == 0.0 and got[3].r > 0.9
    assert got[2].flag == "low_corr" and got[3].flag == "ok"


def test_discrimination_needs_attempts(spark):
    rows = [(1, s, 1, float(10 * s)) for s in range(9)] + [(2, s, 2, 1.0) for s in range(8)] + [(1, 9, 1, None)]
    got = by(items.discrimination_index(facts(spark, rows)).collect(), "question_id")
    assert set(got) == {1} and got[1].label == "strong"


def test_weights_and_gate(spark):
    rows = facts(spark, [(1, s, q, 100.0 * (q == 1)) for s in range(6) for q in (1, 2, 3)] + [(2, s, 1, 50.0) for s in range(6)])
    qs = questions(spark, [(q, 100.0, "", None) for q in (1, 2, 3)])
    weights = [r.weight_pct for r in items.item_weights(rows, qs).where("import_id = 1").collect()]
    assert sum(weights) == pytest.approx(100, abs=0.05)
    gate = {(r.import_id, r.question_id) for r in items.stat_gate(rows, qs).collect()}
    assert gate == {(1, 1), (1, 2), (1, 3), (2, 1)}


def test_reliability(spark):
    rows = [("a", s, q, float(s * 10 + q), 1) for s in range(10) for q in range(3)] + [("a", 99, 0, 1.0, 1), ("a", 0, 0, 0.0, 2)]
    rows += [("b", s, q, 1.0, 1) for s in range(9) for q in range(3)] + [("c", s, 1, 1.0, 1) for s in range(20)]
    df = spark.createDataFrame(rows, "exam_id string, student_id long, question_id long, score double, seq int")
    got = by(reliability.exam_reliability(df).collect(), "exam_id")
    assert got["a"].students == 10 and got["a"].alpha > 0.95 and got["a"].interpretation == "excellent"
    assert (got["b"].alpha, got["c"].alpha, got["c"].k) == (0.0, 0.0, 1)


def test_student_patterns(spark):
    rows = [(1, 1, q, 40.0) for q in range(3)] + [(1, 2, q, 90.0) for q in range(4)] + [(1, 2, 9, 10.0)] + [(1, 3, q, 80.0) for q in range(7)]
    got = by(students.student_risk(facts(spark, rows)).collect(), "student_id")
    assert [got[k].pattern_type for k in (1, 2, 3)] == ["systemic", "spot", "ok"]
    assert [got[k].notes for k in (1, 2, 3)] == ["LOW_OVERALL", "SINGLE_LOW_ITEM", "UNIFORM_SCORES"]


def test_integrity(spark):
    rows = [(1, 1, q, 5.0 * (q % 2)) for q in range(6)] + [(1, 2, q, 5.0 * (q % 2)) for q in range(5)]
    rows += [(1, 100 + s, 50, 7.0 + s % 2) for s in range(11)] + [(1, 100 + s, 51, 7.0 + 3 * (s % 2)) for s in range(11)]
    got = {(r.type, r.student_id, r.question_id) for r in students.integrity_flags(facts(spark, rows)).collect()}
    assert got == {("repeat_pattern", 1, None), ("flat_question", None, 50)}


def test_rules(spark):
    metrics = spark.createDataFrame([(1, 50.0, 0.5, None, 1.0, 10), (2, 50.00005, 0.9, 0.1, 1.0, 10)],
        "question_id long, avg_score double, difficulty_index double, discrimination_index double, reliability double, total_attempts long")
    r = spark.createDataFrame([(1, "a", 2, True), (2, "b", 1, True), (3, "c", 0, False), (4, "d", 0, True), (5, "e", 3, True)],
        "rule_id int, rule_name string, rule_order int, is_active boolean")
    c = spark.createDataFrame([(1, 1, "avg_score", "=", 50.0, None), (2, 1, "difficulty_index", "between", 0.4, 0.9), (3, 1, "avg_score", ">", 0.0, None),
        (5, 1, "discrimination_index", ">=", 0.0, None), (5, 2, "difficulty_index", "between", 0.0, None)],
        "rule_id int, condition_order int, metric_name string, operator string, value_from double, value_to double")
    a = spark.createDataFrame([(1, 1, "set_flag", "x", "said"), (2, 2, "set_category", "y", ""), (3, 5, "set_flag", "z", None)],
        "action_id int, rule_id int, action_type string, action_value string, action_message string")
    got = by(rules.classify(metrics, r, c, a).collect(), "question_id")
    assert all((got[k].categories, got[k].flags, got[k].messages) == (["y"], ["x"], ["said"]) for k in (1, 2))
    assert [x.rule_id for x in rules.nested(r, c, a).collect()] == [3, 4, 2, 1, 5]
    assert not rules.toggled(r, 1).where("rule_id = 1").first().is_active and rules.without(r, 1).count() == 4


def test_scoped_fallback(spark):
    rows = spark.createDataFrame([("en", 1, 10.0, 15.0), ("en", 2, 20.0, 0.0)], "language string, import_id int, final_score double, plagiarism_penalty double")
    assert criteria.answers_by_language(rows, 2).first().avg_score == 20.0
    assert criteria.answers_by_language(rows, 9).first().plagiarism_rate == 50.0


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (3, "e", 3)], "k int, v string, seq int")
    assert sorted(store.insert_ignore(old, new, ["k"], "seq").collect()) == [(1, "a"), (2, "b"), (3, "d")]
    once = store.upsert(old, new, ["k"], "seq")
    assert sorted(once.collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert sorted(store.upsert(once, new, ["k"], "seq").collect()) == sorted(once.collect())


def test_paging(spark):
    rows = paging.ordered(spark.range(120).withColumn("x", F.col("id") % 7), ["id"], ["x"], "x", True)
    pages = [paging.page(rows, k)[0].collect() for k in (1, 2, 3)]
    assert sum(pages, []) == rows.collect() and paging.page(rows, 99)[0].collect() == pages[2]
    assert paging.page(rows.limit(0), 5)[1:] == (0, 1)


def test_imports(spark):
    values = [("12.7", 12), ("-3,9", -3), ("", None), ("-", None), ("abc", None), (" 7 ", 7), ("1e2", 100)]
    df = spark.createDataFrame(values, "x string, want long")
    assert all(r.got == r.want for r in df.select("want", imports.whole(F.col("x")).alias("got")).collect())
    assert imports.resolve(["﻿ Question id", "x"], ["question_id", "Question ID"]) == "﻿ Question id"
    rows = spark.createDataFrame([("1", "Қ", None, "E", "12,5 %"), ("2", "", "R", "E", "5"), ("3", "K", "R", "E", "0")],
        "criteria_id string, kazakh string, russian string, english string, weight string")
    got = imports.criteria(rows).collect()
    assert [r.is_kept for r in got] == [True, False, False] and (got[0].name_russian, got[0].weight_percent) == ("Қ", 12.5)


def test_search(spark):
    assert search.parse_query("q: 12") == ("question", 12) and search.parse_query("Тема 3") == ("topic", 3)
    assert search.parse_query("7") == (None, 7) and search.parse_query("d5") == ("discipline", 5) and search.parse_query("x") == (None, None)
    qs = spark.createDataFrame([(1, "100% sure"), (2, "other")], "question_id long, question_text string")
    ids = {"question": (qs, "question_id", "question_text")}
    words = {"question": (qs, "question_id", ["question_text"])}
    assert [r.entity_id for r in search.search("1", ids, words).collect()] == [1]
    assert search.search("d5", ids, words).count() == 0 == search.search(" ", ids, words).count()
    assert [r.entity_id for r in search.search("0%", ids, words).collect()] == [1]
    assert (search.clamp_k(0), search.clamp_k(31)) == (1, 30)


VECTORS = [(0, "alpha", [1.0, 0.0, 0.0]), (1, "alpha copy", [0.99, 0.01, 0.0]), (2, "beta", [0.0, 1.0, 0.0]), (3, "zero", [0.0, 0.0, 0.0])]


def test_vectors(spark, monkeypatch):
    df = spark.createDataFrame(VECTORS, "id long, text string, vector array<double>")
    assert [(r.id_a, r.id_b) for r in vectors.similar_pairs(df, 0.95).collect()] == [(0, 1)]
    monkeypatch.setattr(vectors, "BLOCK", 1)
    assert [(r.id_a, r.id_b) for r in vectors.similar_pairs(df, 0.95).collect()] == [(0, 1)]
    pairs = spark.createDataFrame([("a", "b", [1.0, 0.0], [0.0, 0.0]), ("a", " ", [1.0, 0.0], [1.0, 0.0]), ("a", "b", [1.0, 0.0], [2.0, 0.0])],
        "text1 string, text2 string, v1 array<double>, v2 array<double>")
    assert [(r.similarity, r.is_duplicate) for r in duplicates.text_pair_similarity(pairs).collect()] == [(0.0, False), (0.0, False), (1.0, True)]


def test_texts(spark):
    df = spark.createDataFrame([("Hello  World", "hello world"), ("abcd", "wxyz"), ("", "a"), ("abc", "ab")], "a string, b string")
    assert [r.s for r in df.select(text.similar_text(F.col("a"), F.col("b")).alias("s")).collect()] == [100.0, 0.0, 0.0, 80.0]
    texts = spark.createDataFrame([(1, "alpha beta gamma"), (2, "Beta, alpha gamma!"), (3, "alpha beta gamma delta"), (4, ""), (5, None)], "id long, text string")
    pairs, classes = duplicates.similar_texts(texts, 0.7)
    assert dict(map(tuple, classes.select("id", "class_id").collect())) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert [(r.id_a, r.id_b) for r in pairs.collect()] == [(1, 3)]
    assert duplicates.compare_two(texts, 1, 2).first().is_potential_duplicate and duplicates.compare_two(texts, 1, 99).count() == 0


def test_rejected_before_in_classes(spark):
    """Copies are members of a class and not pairs; the pairs of all questions follow from both parts."""
    base = ["alpha beta gamma", "alpha beta gamma delta", "omega psi", "", "the of"]
    rows = [(k, base[k % 5] if k < 50 else None, k % 4 == 0, f"r{k}") for k in range(51)] + [(90, "alpha beta", None, "none")]
    got = duplicates.rejected_before(spark.createDataFrame(rows, "question_id long, question_text string, is_rejected boolean, rejection_reason string")).collect()
    pairs = {(r.rejected_class, r.current_class): r.similarity for r in got if r.part == "pair"}
    assert len(pairs) == 5  # three texts with words on each side, of which two resemble each other
    members = [{}, {}]
    for r in got:
        if r.part == "member" and r.question_id != 90:
            members[r.current_class is not None].setdefault(r.current_class if r.rejected_class is None else r.rejected_class, []).append(r.question_id)
    assert sorted(k for side in members for ids in side.values() for k in ids) == list(range(50))
    assert all(r.rejected_reason == (f"r{r.question_id}" if r.rejected_class is not None else None) for r in got if r.part == "member")
    docs = spark.createDataFrame([r[:2] for r in rows if r[1] is not None], "id long, text string")
    weights = {}
    for r in text.tfidf(docs.select("id", text.tokens(F.col("text"), 2, text.STOP_WORDS).alias("tokens"))).collect():
        weights.setdefault(r.id, {})[r.token] = r.weight
    dot = lambda a, b: sum(w * weights.get(b, {}).get(t, 0.0) for t, w in weights.get(a, {}).items())
    want = {(a, b) for a in range(0, 50, 4) for b in range(50) if b % 4 and dot(a, b) > 0.7}
    assert {(a, b) for x, y in pairs for a in members[0][x] for b in members[1][y]} == want
    assert all(s == pytest.approx(dot(x, y), abs=6e-4) for (x, y), s in pairs.items())


def test_statistics(spark):
    df = spark.createDataFrame([(2.5,), (1.005,), (-1.005,)], "x double")
    assert [r[0] for r in df.select(stats.rounded(F.col("x"), 2)).collect()] == [2.5, 1.01, -1.01]
    change = spark.createDataFrame([(5, None), (5, 0), (5, 10), (15, 10)], "now int, before int")
    got = [tuple(r) for r in change.select(*stats.percent_change(F.col("now"), F.col("before"))).collect()]
    assert got == [(0.0, True), (0.0, True), (50.0, False), (50.0, True)]


def test_validation_issues(spark):
    rows = facts(spark, [(1, s, 1, 99.0) for s in range(5)] + [(1, s, 2, 10.0) for s in range(4)] + [(1, 1, 3, None)])
    qs = questions(spark, [(1, 100.0, "alpha beta for", 1), (2, 100.0, "gamma", None), (3, None, "delta", 1)])
    schema = "syllabus_topic_id int, title string, keywords string, topic_code string, discipline_name string"
    topics = spark.createDataFrame([(1, "alpha for", "beta, other", "T1", "d")], schema)
    semantic = spark.createDataFrame([(1, 0.5)], "question_id int, semantic double")
    got = by(alignment.validation(rows, qs, topics, semantic, Coefficients()).collect(), "question_id")
    assert set(got) == {1, 3}  # linked ones
    assert [got[k].issues for k in (1, 3)] == ["HIGH_AVG", "LOW_AVG,FEW_ATTEMPTS,NO_EMBEDDINGS"]
    assert (got[1].attempts, got[3].attempts, got[3].avg_score, got[1].topic_code) == (5, 1, 0.0, "T1")
    assert alignment.validate_one(rows, qs, topics, 1).first().issues == "HIGH_AVG,NO_EMBEDDINGS"
    assert got[1].keyword_coverage == pytest.approx(66.7)  # "for" is no token


def test_rejected_similarity_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "TEXTS", 7)
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name", "p_type").collect()
    qs = [(r.p_partkey, f"{r.p_name} {r.p_type}") for r in part] + [(9001, None), (9002, ""), (9003, "Ж " * 9)]
    rejected = [(r.p_partkey, r.p_type) for r in part[:30]] + [(1, None), (2, "Ж ж"), (3, "")]
    got = duplicates.rejected_similarity(spark.createDataFrame(qs, "question_id long, question_text string"),
        spark.createDataFrame(rejected, "rejected_id long, rejected_text string"))
    all_pairs = [(q, x, text._similar(a, b)) for q, a in qs for x, b in rejected if a and b]
    want = [(q, x, s, "high" if s >= 55 else "medium") for q, x, s in all_pairs if s >= 35]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) < len(all_pairs)


def test_cosine_join_in_blocks(spark, monkeypatch):
    """A token of all texts, met in blocks, gives the pairs of all pairs."""
    rng = random.Random(4)
    texts = [(k, " ".join(["common", *rng.choices([f"word{j}" for j in range(12)], k=rng.randint(1, 8))])) for k in range(150)] + [(900, ""), (901, None), (902, "the of")]
    df = spark.createDataFrame(texts, "id long, text string")

    def pairs():
        return sorted((r.id_a, r.id_b, r.similarity) for r in duplicates.similar_texts(df, 0.7)[0].collect())

    plain = pairs()
    monkeypatch.setattr(duplicates, "POSTINGS", 5)
    assert pairs() == plain and len(plain) > 100
    weights = {}
    heads = {r.class_id for r in duplicates.text_classes(df).collect()}
    docs = df.where(F.col("id").isin(list(heads))).select("id", text.tokens(F.col("text"), 2, text.STOP_WORDS).alias("tokens"))
    for r in text.tfidf(docs).collect():
        weights.setdefault(r.id, {})[r.token] = r.weight
    dot = lambda a, b: sum(w * b.get(t, 0.0) for t, w in a.items())
    want = {(a, b) for a in weights for b in weights if a < b and dot(weights[a], weights[b]) > 0.7}
    assert {(a, b) for a, b, _ in plain} == want


def test_candidates_of_the_cosine_join_are_few(spark):
    """Texts that share rare words with many others, and little else, are no candidates, so that few vectors are sent for a check."""
    rng = random.Random(5)
    texts = [(k, " ".join([*rng.choices([f"rare{j}" for j in range(30)], k=2), *rng.choices([f"word{j}" for j in range(60)], k=14)])) for k in range(300)]
    texts += [(1000 + k, t + " word1") for k, t in texts[:40]]
    vectors = duplicates._vectors(duplicates._keyed(spark.createDataFrame(texts, "id long, text string")))
    prefix = duplicates._prefixes(vectors, 0.85).cache()
    candidates = duplicates._candidates(prefix, prefix, 0.85)
    found = duplicates._cosines(candidates, vectors).where("s > 0.85").count()
    assert found == 40 and candidates.count() <= 125 * found


def test_text_classes_run_without_python(spark, monkeypatch):
    """Whole texts aren't sent to Python workers for their classes."""
    monkeypatch.setattr(F, "arrow_udf", None)
    rows = duplicates.text_classes(spark.createDataFrame([(1, "alpha beta"), (2, "Beta alpha"), (3, "")], "id long, text string"))
    assert dict(map(tuple, rows.collect())) == {1: 1, 2: 1, 3: 3}


def clustered(n, centres=20, dim=16, width=0.02):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(centres, dim))
    return [(k, (middle[k % centres] + width * rng.normal(size=dim)).tolist()) for k in range(n)]


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_pairs_are_pruned_and_whole(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = clustered(600) + [(1000, [0.0] * 16), (1001, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    m = np.array([v for _, v in rows[:600]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for threshold in (0.99, 0.5, 0.0):
        got = sorted((r.id_a, r.id_b) for r in vectors.similar_pairs(df, threshold).collect())
        assert got == [(a, b) for a, b in zip(*np.nonzero(np.triu(m @ m.T > threshold, 1)), strict=True)]
    met = vectors.met(df.where("id < 1000"), 0.99).groupBy("cell", "i", "j").agg(F.count_if("guest").alias("g"), F.count_if(~F.col("guest")).alias("h"), F.expr("count_if(own = j AND NOT guest)").alias("b")).collect()
    compared = sum(r.g * r.h if r.i < 0 else (r.h * r.h / 2 if r.i == r.j else (r.h - r.b) * r.b) for r in met)
    assert compared < 0.3 * 600 * 599 / 2


def test_vector_index_is_exact_and_skips_cells(spark, tmp_path):
    rows = clustered(500) + [(1000, [0.0] * 16), (1001, None)]
    index = vectors.VectorIndex(spark.createDataFrame(rows, "id long, vector array<double>"), str(tmp_path / "v"))
    m = np.array([v for _, v in rows[:500]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for k, query in ((5, rows[3][1]), (60, rows[4][1]), (500, rows[0][1]), (700, rows[0][1]), (3, [1.0] + [0.0] * 15)):
        s = m @ (np.array(query) / np.linalg.norm(query))
        want = sorted(range(500), key=lambda x, s=s: (-s[x], x))[:k]
        assert sorted(r.id for r in index.nearest(query, k).collect()) == sorted(want)
    near = index.within(rows[3][1], 0.3)
    read = index.rows().where(F.col("cell").isin(near)).count()
    assert 25 <= read < 0.3 * 500
    assert "PartitionFilters: [cell" in index.nearest(rows[3][1], 5)._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "").replace("#", " ") or len(near) < len(index.cells)


def test_store_edges(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "import_id int, x string")
    store.append_partition(rows, path)
    store.append_partition(rows.where("import_id = 1"), path)
    assert spark.read.parquet(path).count() == 3
    store.replace_table(spark.read.parquet(path).where("import_id = 1"), path)
    assert spark.read.parquet(path).count() == 2 and len([p for p in tmp_path.iterdir() if p.name.startswith("t")]) == 1
    assert {r.json for r in store.as_json(rows).collect()} == {'{"import_id":1,"x":"a"}', '{"import_id":2,"x":null}'}
    store.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), sep=";", header=True).count() == 2
    assert store.rows_of(spark, "SELECT :a || 'x' AS v", a="' OR 1").first().v == "' OR 1x"


def test_criteria_by_name_or_position(spark):
    named = spark.createDataFrame([("1", "к", "р", "10")], ["ID критерия", "Наименование критерия на казахском", "Наименование критерия на русском", "Доля"])
    assert tuple(imports.criteria_columns(named).first()) == ("1", "к", "р", None, "10")
    assert tuple(imports.criteria_columns(spark.createDataFrame([("1", "к", "7")], ["a", "b", "c"])).first()) == ("1", "к", "7", None, "7")


def test_tallies_add_up(spark):
    rows = facts(spark, [(1, s, q, float(s * q % 100)) for s in range(20) for q in range(5)])
    qs = questions(spark, [(q, 100.0, "", None) for q in range(5)])
    got = dashboards.tallies({"quality": (items.item_quality(rows, qs), "flag")}).collect()
    assert sum(r.n for r in got) == 5
