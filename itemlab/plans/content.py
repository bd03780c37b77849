"""Queries on texts, vectors, rules and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables, with_tables
from ..functions import text as texts
from ..functions import vectors
from ..operators import alignment as aligned
from ..operators import caches, dashboards, duplicates, items, rules, store
from ..operators import search as searching
from ..operators.commits import Store
from .exam import LEVEL, MEANS, METRICS, PER_STUDENT, QUALITY, RISK, TOTAL, index_sql, r

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STOPPED = "['и', 'в', 'на', 'с', 'для', 'по', 'из', 'к', 'а', 'the', 'and', 'of', 'to', 'in', 'for', 'with', 'on', 'at', 'from', 'by']"


def tokens_sql(text: str, least: int = 2, stop: bool = False) -> str:
    words = f"string_split_regex(regexp_replace(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+')"
    more = f" AND NOT list_contains({STOPPED}, w)" if stop else ""
    return f"[w FOR w IN {words} IF length(w) > {least}{more}]"


@query(
    f"""SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) <= 50"""
)
def top_tokens(t: Tables):
    """The fifty most frequent words of each language."""
    from pyspark.sql import Window

    rows = t.read("documents").select("lang", F.explode(texts.tokens(F.col("text"))).alias("token"))
    rows = rows.groupBy("lang", "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "token")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 50").drop("rank")


COVERAGE = f"""covered AS (SELECT question_id,
  list_distinct({tokens_sql("title || ' ' || keywords", 2, True)}) AS a, list_distinct({tokens_sql('question_text', 2, True)}) AS b
  FROM questions JOIN topics USING (syllabus_topic_id)),
coverage AS (SELECT question_id, {r('''100 * CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0
  ELSE len(list_intersect(a, b))::DOUBLE / len(a) END''', 1)} AS keyword_coverage FROM covered)"""


@query(with_tables("questions", "topics", more=COVERAGE) + "SELECT * FROM coverage")
def keyword_coverage(t: Tables):
    return aligned.keyword_coverage(t.questions(), t.topics())


PAIRED = f"""pairs AS (SELECT question_id, unnest([0, 1]) AS side, unnest([{tokens_sql('question_text', 2, True)},
  {tokens_sql("title || ' ' || keywords", 2, True)}]) AS tokens FROM questions JOIN topics USING (syllabus_topic_id)),
paired AS (SELECT question_id, side, token, count(*) / any_value(n) * ln(2.0::DOUBLE / count(DISTINCT side) OVER (PARTITION BY question_id, token)) AS w
  FROM (SELECT question_id, side, len(tokens)::DOUBLE AS n, unnest(tokens) AS token FROM pairs) GROUP BY question_id, side, token),
norms AS (SELECT question_id, sum(w * w) FILTER (WHERE side = 0) * sum(w * w) FILTER (WHERE side = 1) AS n FROM paired GROUP BY 1),
dots AS (SELECT question_id, sum(a.w * b.w) AS dot FROM paired a JOIN paired b USING (question_id, token) WHERE a.side = 0 AND b.side = 1 GROUP BY 1)"""


@query(
    with_tables("questions", "topics", more=PAIRED)
    + """SELECT question_id, CASE WHEN n > 0 THEN coalesce(dot, 0) / sqrt(n) ELSE 0 END AS similarity
FROM questions JOIN topics USING (syllabus_topic_id) LEFT JOIN norms USING (question_id) LEFT JOIN dots USING (question_id)"""
)
def tfidf_pair_faithful(t: Tables):
    return aligned.text_similarity(t.questions(), t.topics(), "faithful")


TFIDF = f"""docs AS (SELECT 'q' || question_id AS id, {tokens_sql('question_text', 2, True)} AS tokens FROM questions
  UNION ALL SELECT 't' || syllabus_topic_id, {tokens_sql("title || ' ' || keywords", 2, True)} FROM topics),
counts AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM docs) GROUP BY 1, 2),
weighted AS (SELECT id, token, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + count(*) OVER (PARTITION BY token))) + 1) AS w FROM counts),
weights AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM weighted),
similar_texts AS (SELECT question_id, coalesce(sum(a.weight * b.weight), 0) AS similarity
  FROM questions JOIN topics USING (syllabus_topic_id) LEFT JOIN weights a ON a.id = 'q' || question_id
  LEFT JOIN weights b ON b.id = 't' || syllabus_topic_id AND b.token = a.token GROUP BY 1)"""
ATTEMPTS = """attempts AS (SELECT import_id, question_id, avg(received_score) AS mean, count(DISTINCT student_id) AS students FROM facts GROUP BY 1, 2)"""


@query(with_tables("questions", "topics", more=TFIDF) + f"SELECT question_id, {r('similarity', 4)} AS similarity FROM similar_texts")
def tfidf_corpus(t: Tables):
    from ..functions.stats import rounded

    rows = aligned.text_similarity(t.questions(), t.topics())
    return rows.select("question_id", rounded(F.col("similarity"), 4).alias("similarity"))


@query(
    with_tables("facts", "questions", "topics", more=ATTEMPTS)
    + f"""SELECT import_id, question_id, syllabus_topic_id, title, discipline_name, {r('mean', 2)} AS avg_score, students FROM attempts
JOIN questions USING (question_id) JOIN topics USING (syllabus_topic_id)"""
)
def alignment_base(t: Tables):
    return aligned.questions_for_analysis(t.facts(), t.questions(), t.topics())


PAIR = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"
#: The first vectors are those of questions and of topics; later questions have none.
SEMANTIC = f"""semantic AS (SELECT question_id, {PAIR} AS semantic FROM questions JOIN topics USING (syllabus_topic_id)
  JOIN embeddings a ON a.vec_id = question_id JOIN embeddings b ON b.vec_id = syllabus_topic_id)"""
ALIGNED = f"""{SEMANTIC},
aligned AS (SELECT import_id, question_id, syllabus_topic_id, title, discipline_name, {r('similarity', 3)} AS text_similarity, {r('coalesce(semantic, 0)', 3)} AS semantic_similarity,
  {r('0.6::DOUBLE * similarity + 0.4::DOUBLE * coalesce(semantic, 0)', 3)} AS combined_score, {r('mean', 2)} AS average_score, students AS student_attempts, semantic
  FROM attempts JOIN questions USING (question_id) JOIN topics USING (syllabus_topic_id) JOIN similar_texts USING (question_id) LEFT JOIN semantic USING (question_id))"""


def _semantic(t: Tables) -> DataFrame:
    of = lambda key: t.read("embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias("vector"))
    return aligned.semantic_similarity(t.questions(), t.topics(), of("question_id"), of("syllabus_topic_id"))


@query(
    with_tables("facts", "questions", "topics", more=",\n".join([ATTEMPTS, TFIDF, ALIGNED]))
    + "SELECT * EXCLUDE (semantic), CASE WHEN combined_score < 0.15 THEN 'low' WHEN combined_score < 0.4 THEN 'medium' ELSE 'high' END AS alignment_level FROM aligned"
)
def syllabus_alignment(t: Tables):
    return aligned.alignment(t.facts(), t.questions(), t.topics(), _semantic(t))


@query(
    with_tables("facts", "questions", "topics", more=",\n".join([ATTEMPTS, TFIDF, ALIGNED, COVERAGE]))
    + f"""SELECT import_id, question_id, title, topic_code, keyword_coverage, {r('100 * combined_score', 1)} AS tfidf_score, {r('100 * coalesce(semantic, 0)', 1)} AS semantic_similarity,
  {r('0.3::DOUBLE * keyword_coverage + 0.4::DOUBLE * 100 * combined_score + 0.3::DOUBLE * 100 * coalesce(semantic, 0)', 1)} AS combined_score, {r('mean', 2)} AS avg_score, students AS attempts,
  concat_ws(',', CASE WHEN mean < 0.3::DOUBLE * coalesce(max_score, 100) THEN 'LOW_AVG' END,
    CASE WHEN mean > 0.95::DOUBLE * coalesce(max_score, 100) THEN 'HIGH_AVG' END,
    CASE WHEN students < 5 THEN 'FEW_ATTEMPTS' END, CASE WHEN semantic IS NULL THEN 'NO_EMBEDDINGS' END) AS issues,
  CASE WHEN semantic IS NOT NULL AND mean BETWEEN 0.3::DOUBLE * coalesce(max_score, 100) AND 0.95::DOUBLE * coalesce(max_score, 100) AND students >= 5 THEN 'ok' ELSE 'warning' END AS status
  FROM attempts JOIN questions USING (question_id) JOIN (SELECT syllabus_topic_id, topic_code FROM topics) USING (syllabus_topic_id)
  JOIN coverage USING (question_id) JOIN aligned USING (import_id, question_id)"""
)
def validation_overview(t: Tables):
    return aligned.validation(t.facts(), t.questions(), t.topics(), _semantic(t))


@query(
    with_tables("facts", "questions", "topics", more=",\n".join([ATTEMPTS, TFIDF, ALIGNED]))
    + """SELECT what, import_id, NULL::BIGINT AS question_id, NULL AS value FROM (VALUES ('1 validation', 1), ('1 alignment', 1), ('1 validation', 2), ('1 alignment', 2),
  ('1 validation', 3), ('1 alignment', 3), ('3 validation', 2), ('3 alignment', 2)) v(what, import_id) WHERE import_id IN (SELECT import_id FROM facts)
UNION ALL SELECT 'status', import_id, question_id, CASE WHEN semantic IS NOT NULL AND mean BETWEEN 0.3::DOUBLE * coalesce(max_score, 100)
    AND 0.95::DOUBLE * coalesce(max_score, 100) AND students >= 5 THEN 'ok' ELSE 'warning' END
  FROM aligned JOIN attempts USING (import_id, question_id) JOIN questions USING (question_id) WHERE import_id = 1
UNION ALL SELECT 'level', import_id, question_id, CASE WHEN combined_score < 0.15 THEN 'low' WHEN combined_score < 0.4 THEN 'medium' ELSE 'high' END
  FROM aligned WHERE import_id = 3
UNION ALL SELECT 'students', 2, question_id, count(DISTINCT student_id)::VARCHAR FROM facts JOIN questions USING (question_id) JOIN topics USING (syllabus_topic_id)
  WHERE import_id = 2 AND raw_id % 5 <> 0 GROUP BY question_id"""
)
def caches_refreshed(t: Tables):
    """Three refreshes of both caches, of which the second finds nothing changed and the third one import with fewer facts."""
    path = store.shared_path(t.spark, "caches")
    validation, alignment = caches.Cache(t.spark, f"{path}/v", caches.VALIDATION), caches.Cache(t.spark, f"{path}/a", caches.ALIGNMENT)
    facts, semantic = t.facts(), _semantic(t)
    fewer = facts.where("import_id <> 2 OR raw_id % 5 <> 0")
    done = [caches.refresh_caches(validation, alignment, rows, t.questions(), t.topics(), semantic) for rows in (facts, facts, fewer)]
    report = [(f"{k} {name}", i) for k, refreshed in enumerate(done, 1) for name, ids in refreshed.items() for i in ids]
    none = lambda kind: F.lit(None).cast(kind)
    out = t.spark.createDataFrame(report, "what string, import_id int").select("what", "import_id", none("long").alias("question_id"), none("string").alias("value"))
    parts = [("status", validation.rows(1), "status"), ("level", alignment.rows(3), "alignment_level"), ("students", validation.rows(2), "attempts")]
    return reduce(DataFrame.unionAll, [out, *(rows.select(F.lit(what), "import_id", "question_id", F.col(c).cast("string")) for what, rows, c in parts)])


@query(
    with_tables("facts", "questions", "topics", "criteria", "details", "works", "answers",
        more=",\n".join([MEANS, QUALITY, TOTAL, PER_STUDENT, RISK, ATTEMPTS, TFIDF, ALIGNED]))
    + f"""SELECT section, flag, badge, count(*) AS n FROM (
  SELECT 'validation' AS section, flag, CASE flag WHEN 'ok' THEN 'success' ELSE 'warning' END AS badge FROM (SELECT CASE WHEN semantic IS NOT NULL
    AND mean BETWEEN 0.3::DOUBLE * coalesce(max_score, 100) AND 0.95::DOUBLE * coalesce(max_score, 100) AND students >= 5 THEN 'ok' ELSE 'warning' END AS flag
    FROM aligned JOIN attempts USING (import_id, question_id) JOIN questions USING (question_id))
  UNION ALL SELECT 'quality', flag, CASE flag WHEN 'normal' THEN 'success' WHEN 'too_easy' THEN 'warning' ELSE 'danger' END FROM quality
  UNION ALL SELECT 'correlation', CASE WHEN abs(r) < 0.12 THEN 'low_corr' ELSE 'ok' END, CASE WHEN abs(r) < 0.12 THEN 'warning' ELSE 'success' END FROM correlated
  UNION ALL SELECT 'students', pattern_type, CASE pattern_type WHEN 'ok' THEN 'success' WHEN 'systemic' THEN 'danger' ELSE 'warning' END FROM risk
  UNION ALL SELECT 'semantic', CASE WHEN combined_score < 0.15 THEN 'low' WHEN combined_score < 0.4 THEN 'medium' ELSE 'high' END,
    CASE WHEN combined_score < 0.15 THEN 'danger' WHEN combined_score < 0.4 THEN 'warning' ELSE 'success' END FROM aligned
  UNION ALL SELECT 'criteria', {LEVEL}, 'success' FROM details JOIN works USING (work_id) JOIN criteria USING (criteria_key) GROUP BY criteria_id
  UNION ALL SELECT 'answers', CASE WHEN rate > 10 THEN 'high' ELSE 'low' END, CASE WHEN rate > 10 THEN 'danger' WHEN rate > 5 THEN 'warning' ELSE 'success' END
    FROM (SELECT 100.0 * count(*) FILTER (WHERE plagiarism_penalty > 0) / count(*) AS rate FROM answers GROUP BY language)) GROUP BY 1, 2, 3"""
)
def section_badges(t: Tables):
    """Rows of all seven sections by flag and badge."""
    return dashboards.section_tallies(
        dashboards.section_tables(t.facts(), t.questions(), t.topics(), t.details(), t.criteria(), t.works(), t.answers(), _semantic(t))
    )


@query(
    with_tables("facts", "questions", "topics", "criteria", "details", "works", "answers",
        more=",\n".join([MEANS, QUALITY, TOTAL, PER_STUDENT, RISK, ATTEMPTS, TFIDF, ALIGNED]))
    + """SELECT * FROM (SELECT 'validation' AS section, row_number() OVER (ORDER BY students DESC, import_id, question_id) AS position, import_id || '/' || question_id AS id FROM aligned JOIN attempts USING (import_id, question_id))
  WHERE position BETWEEN 51 AND 100
UNION ALL SELECT * FROM (SELECT 'quality', row_number() OVER (ORDER BY difficulty_pct DESC, import_id, question_id) AS position, import_id || '/' || question_id FROM quality WHERE flag = 'too_hard') WHERE position <= 50
UNION ALL SELECT * FROM (SELECT 'correlation', row_number() OVER (ORDER BY import_id, question_id) AS position, import_id || '/' || question_id FROM correlated) WHERE position <= 50
UNION ALL SELECT * FROM (SELECT 'students', row_number() OVER (ORDER BY min_item, import_id, student_id) AS position, import_id || '/' || student_id FROM risk) WHERE position <= 50
UNION ALL SELECT * FROM (SELECT 'semantic', row_number() OVER (ORDER BY title, import_id, question_id) AS position, import_id || '/' || question_id FROM aligned) WHERE position <= 50
UNION ALL SELECT 'criteria', row_number() OVER (ORDER BY name DESC), (ascii(name) * 1000 + length(name)) || '' FROM criteria WHERE criteria_key IN (SELECT criteria_key FROM details)
UNION ALL SELECT 'answers', row_number() OVER (ORDER BY n, language), language FROM (SELECT language, count(*) AS n FROM answers GROUP BY 1)"""
)
def section_pages(t: Tables):
    """A page of each section: by allowed names, by one that isn't, of one badge, and the second page."""
    tables = dashboards.section_tables(t.facts(), t.questions(), t.topics(), t.details(), t.criteria(), t.works(), t.answers(), _semantic(t))
    wanted = {
        "validation": {"sort": "attempts", "descending": True, "number": 2}, "quality": {"sort": "difficulty_pct", "descending": True, "badge": "danger"},
        "correlation": {"sort": "r; DROP", "descending": True}, "students": {"sort": "min_item"}, "semantic": {"sort": "syllabus_title"},
        "criteria": {"sort": "name", "descending": True}, "answers": {"sort": "total_answers"},
    }
    parts = []
    for section, choice in wanted.items():
        rows = dashboards.section_page(tables[section], section, **choice)[0]
        parts.append(rows.select(F.lit(section).alias("section"), "position", F.concat_ws("/", *dashboards.SECTION_KEYS[section]).alias("id")))
    return reduce(DataFrame.unionAll, parts)


@query(
    """SELECT doc_id, keyword_coverage, CASE WHEN length(text) < 15 THEN 'short' WHEN keyword_coverage < 0.2 THEN 'weak' ELSE 'ok' END AS quality_hint
FROM (SELECT doc_id, text, CAST(round(CAST(len([k FOR k IN keys IF contains(lower(text), lower(k))])::DOUBLE / len(keys) AS DECIMAL(18,6)), 3) AS DOUBLE)
  AS keyword_coverage FROM (SELECT doc_id, text, CASE lang WHEN 'en' THEN ['the', 'tion', 'zebra'] WHEN 'de' THEN ['der', 'Keit'] WHEN 'fr' THEN ['la'] END AS keys FROM documents))"""
)
def open_answer_keywords(t: Tables):
    from ..functions.stats import rounded

    keys = F.when(F.col("lang") == "en", "the, tion; zebra,").when(F.col("lang") == "de", "der;Keit").when(F.col("lang") == "fr", "la")
    rows = t.read("documents").select("doc_id", "text", texts.keyword_coverage(F.col("text"), keys).alias("share"))
    rows = rows.select("doc_id", "text", rounded(F.col("share"), 3).alias("keyword_coverage"))
    hint = F.when(F.length("text") < 15, "short").when(F.col("keyword_coverage") < 0.2, "weak").otherwise("ok")
    return rows.select("doc_id", "keyword_coverage", hint.alias("quality_hint"))


@query()
def rejected_similarity(t: Tables):
    """Questions that resemble the topics' titles, taken as rejected; a Python kernel, tested by itself."""
    rejected = t.topics().select(F.col("syllabus_topic_id").alias("rejected_id"), F.col("title").alias("rejected_text"))
    return duplicates.rejected_similarity(t.questions(), rejected)


@query(
    f"""SELECT a.vec_id AS id_a, b.vec_id AS id_b, {r(PAIR, 4)} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE {PAIR} > 0.4"""
)
def duplicate_vectors(t: Tables):
    from ..functions.stats import rounded

    rows = t.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pairs = vectors.similar_pairs(rows, 0.4)
    return pairs.select("id_a", "id_b", rounded(F.col("similarity"), 4).alias("similarity"))


@query(
    f"""SELECT b.vec_id AS entity_id, CASE WHEN b.label % 2 = 0 THEN 'question' ELSE 'topic' END AS entity_type, b.label::VARCHAR AS content,
  {r(PAIR, 4)} AS similarity FROM (SELECT [{', '.join(str(0.1 * (k % 5 - 2)) for k in range(64))}]::DOUBLE[] AS embedding) a, embeddings b
ORDER BY {PAIR} DESC, b.vec_id LIMIT 10"""
)
def vector_topk(t: Tables):
    from ..functions.stats import rounded

    kind = F.when(F.col("label") % 2 == 0, "question").otherwise("topic")
    index = t.read("embeddings").select(
        kind.alias("entity_type"), F.col("vec_id").alias("entity_id"), F.col("label").cast("string").alias("content"), "embedding"
    )
    found = searching.by_vector(index, [0.1 * (k % 5 - 2) for k in range(64)], 10)
    return found.withColumn("similarity", rounded(F.col("similarity"), 4))


@query(
    f"""SELECT b.vec_id AS id, {r(PAIR, 4)} AS similarity FROM (SELECT embedding FROM embeddings WHERE vec_id = 7) a, embeddings b
ORDER BY {PAIR} DESC, b.vec_id LIMIT 25"""
)
def vector_index(t: Tables):
    """The vectors nearest to one of them, by an index whose cells are pruned."""
    from ..functions.stats import rounded

    rows = t.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    query_vector = [float(x) for x in rows.where("id = 7").first().vector]
    found = vectors.VectorIndex(rows, store.shared_path(t.spark, "vectors")).nearest(query_vector, 25)
    return found.select("id", rounded(F.col("similarity"), 4).alias("similarity"))


SAME = f"""keyed AS (SELECT doc_id AS id, array_to_string(list_sort({tokens_sql('text', 2, True)}), ' ') AS k FROM documents)"""


@query("WITH " + SAME + " SELECT id, CASE WHEN k = '' THEN id ELSE min(id) OVER (PARTITION BY k) END AS class_id FROM keyed")
def text_classes(t: Tables):
    """Documents of the same words, with the class of each."""
    return duplicates.text_classes(t.read("documents").select(F.col("doc_id").alias("id"), "text"))


@query(
    "WITH " + SAME + f""", docs AS (SELECT doc_id AS id, {tokens_sql('text', 2, True)} AS tokens FROM documents
  WHERE doc_id IN (SELECT CASE WHEN k = '' THEN id ELSE min(id) OVER (PARTITION BY k) END FROM keyed)),
counts AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM docs) GROUP BY 1, 2),
weighted AS (SELECT id, token, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + count(*) OVER (PARTITION BY token))) + 1) AS w FROM counts),
weights AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM weighted)
SELECT a.id AS id_a, b.id AS id_b, {r('sum(a.weight * b.weight)', 3)} AS similarity FROM weights a JOIN weights b ON a.token = b.token AND a.id < b.id
GROUP BY 1, 2 HAVING sum(a.weight * b.weight) > 0.85"""
)
def similar_questions(t: Tables):
    """Pairs of documents, one of each class, whose tf-idf cosine is above 0.85."""
    return duplicates.similar_texts(t.read("documents").select(F.col("doc_id").alias("id"), "text"))[0]


PARTS_TFIDF = f"""docs AS (SELECT question_id AS id, {tokens_sql('question_text', 2, True)} AS tokens FROM questions),
counts AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM docs) GROUP BY 1, 2),
weighted AS (SELECT id, token, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1.0::DOUBLE + count(*) OVER (PARTITION BY token))) + 1) AS w FROM counts),
weights AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM weighted)"""


@query(
    with_tables("questions", more=PARTS_TFIDF)
    + f""", classes AS (SELECT id, id % 40 = 0 AS is_rejected, CASE WHEN len(tokens) = 0 THEN id ELSE min(id) OVER (PARTITION BY list_sort(tokens), id % 40 = 0) END AS class_id FROM docs),
heads AS (SELECT * FROM weights WHERE id IN (SELECT class_id FROM classes))
SELECT 'pair' AS part, a.id AS rejected_class, b.id AS current_class, {r('sum(a.weight * b.weight)', 3)} AS similarity, NULL::BIGINT AS question_id, NULL AS rejected_reason
FROM heads a JOIN heads b USING (token) WHERE a.id % 40 = 0 AND b.id % 40 <> 0 GROUP BY a.id, b.id HAVING sum(a.weight * b.weight) > 0.7
UNION ALL SELECT 'member', CASE WHEN is_rejected THEN class_id END, CASE WHEN NOT is_rejected THEN class_id END, NULL, id, CASE WHEN is_rejected THEN 'reason ' || id % 3 END FROM classes"""
)
def rejected_before(t: Tables):
    """Each fortieth question is a rejected one; pairs of classes, and the class of each question."""
    key = F.col("question_id")
    rows = t.questions().withColumns({"is_rejected": key % 40 == 0, "rejection_reason": F.concat(F.lit("reason "), (key % 3).cast("string"))})
    return duplicates.rejected_before(rows)


@query(
    with_tables("questions", more=PARTS_TFIDF)
    + f"""SELECT {r('coalesce(sum(a.weight * b.weight), 0)', 3)} AS similarity, coalesce(sum(a.weight * b.weight), 0) > 0.85 AS is_potential_duplicate
FROM weights a JOIN weights b USING (token) WHERE a.id = 3 AND b.id = 7"""
)
def compare_two_questions(t: Tables):
    return duplicates.compare_two(t.questions().select(F.col("question_id").alias("id"), F.col("question_text").alias("text")), 3, 7)


def _rules(t: Tables):
    s = t.spark
    rows = s.createDataFrame(
        [(1, "hard", 10, True), (2, "easy", 20, True), (3, "off", 5, False), (4, "empty", 1, True), (5, "band", 15, True)],
        "rule_id int, rule_name string, rule_order int, is_active boolean",
    )
    conditions = s.createDataFrame(
        [(1, 1, "difficulty_index", ">=", 0.5, None), (1, 2, "total_attempts", ">", 20.0, None), (2, 1, "difficulty_index", "<", 0.3, None),
         (3, 1, "avg_score", ">", 0.0, None), (5, 1, "avg_score", "between", 40.0, 60.0), (5, 2, "discrimination_index", ">", 0.1, None)],
        "rule_id int, condition_order int, metric_name string, operator string, value_from double, value_to double",
    )
    actions = s.createDataFrame(
        [(1, 1, "set_category", "hard", "revise"), (2, 1, "set_flag", "review", None), (3, 2, "set_category", "easy", ""),
         (4, 5, "set_category", "middle", "fine"), (5, 3, "set_flag", "never", "never")],
        "action_id int, rule_id int, action_type string, action_value string, action_message string",
    )
    return rows, conditions, actions


@query(
    with_tables("facts", "questions", more=index_sql(2) + ",\n" + METRICS)
    + """, fired AS (SELECT question_id, difficulty_index >= 0.5 AND total_attempts > 20 AS hard, difficulty_index < 0.3 AS easy,
  avg_score BETWEEN 40 AND 60 AND discrimination_index > 0.1 AS band FROM metrics)
SELECT question_id, concat_ws(',', CASE WHEN hard THEN 'hard' END, CASE WHEN band THEN 'middle' END, CASE WHEN easy THEN 'easy' END) AS categories,
  CASE WHEN hard THEN 'review' ELSE '' END AS flags, concat_ws(',', CASE WHEN hard THEN 'revise' END, CASE WHEN band THEN 'fine' END) AS messages
FROM fired WHERE hard OR easy OR band"""
)
def rule_classification(t: Tables):
    rows = rules.classify(items.question_metrics(t.facts(), t.questions()), *_rules(t))
    return rows.select("question_id", *(F.array_join(c, ",").alias(c) for c in ("categories", "flags", "messages")))


@query(
    with_tables("facts", "questions", more=index_sql(2) + ",\n" + METRICS)
    + """, fired AS (SELECT question_id, difficulty_index >= 0.5 AS hard, avg_score BETWEEN 40 AND 60 AS band, total_attempts < 25 AS few FROM metrics)
SELECT question_id, concat_ws(',', CASE WHEN band THEN 'poor_discrimination' END, CASE WHEN hard THEN 'too_difficult' END, CASE WHEN few THEN 'insufficient_attempts' END) AS categories,
  concat_ws(',', CASE WHEN hard THEN 'revise' END, CASE WHEN few THEN 'more' END) AS messages FROM fired WHERE hard OR band OR few"""
)
def rules_built(t: Tables):
    """Three rules put into their tables by the builder, and what they say of the questions."""
    tables = Store(t.spark, store.shared_path(t.spark, "rules"), rules.RULE_TABLES)
    rules.create_rule(tables, "hard", "difficulty_index", ">=", "0.5", "too_difficult", message="revise", order=2)
    rules.create_rule(tables, "band", "avg_score", "between", 40, "poor_discrimination", "60")
    rules.create_rule(tables, " few ", "total_attempts", "<", "25", "insufficient_attempts", "ignored", " more ", 3)
    rows = rules.classify(items.question_metrics(t.facts(), t.questions()), *(tables.read(name) for name in rules.RULE_TABLES))
    return rows.select("question_id", *(F.array_join(c, ",").alias(c) for c in ("categories", "messages")))


@query(
    """WITH conditions AS (SELECT s_nationkey AS rule_id, string_agg(s_suppkey || ' ' || CASE WHEN s_suppkey % 2 = 0 THEN '>=' ELSE '<' END || ' ' || s_suppkey % 7, ', ' ORDER BY s_suppkey) AS conditions
  FROM supplier GROUP BY 1),
actions AS (SELECT c_nationkey AS rule_id, string_agg(c_custkey || ' ' || c_name, ', ' ORDER BY c_custkey) AS actions FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 4 <> 0 GROUP BY 1)
SELECT n_nationkey AS rule_id, n_name AS rule_name, coalesce(conditions, '') AS conditions, coalesce(actions, '') AS actions
FROM nation LEFT JOIN conditions c ON n_nationkey = c.rule_id LEFT JOIN actions a ON n_nationkey = a.rule_id"""
)
def rules_nested(t: Tables):
    """Nations as rules, their suppliers as conditions and some of their customers as actions; a fourth of the rules has no action."""
    key, supplier = F.col("n_nationkey"), F.col("s_suppkey")
    rules_ = t.read("nation").select(key.alias("rule_id"), F.col("n_name").alias("rule_name"), key.alias("rule_order"))
    conditions = t.read("supplier").select(
        F.col("s_nationkey").alias("rule_id"), supplier.alias("condition_order"), supplier.cast("string").alias("metric_name"),
        F.when(supplier % 2 == 0, ">=").otherwise("<").alias("operator"), (supplier % 7).alias("value_from"), F.lit(None).cast("long").alias("value_to"),
    )
    actions = t.read("customer").where("c_custkey % 3 = 0 AND c_nationkey % 4 <> 0").select(
        F.col("c_nationkey").alias("rule_id"), F.col("c_custkey").alias("action_id"), F.col("c_name").alias("action_type"), F.lit("").alias("action_value")
    )
    text = lambda c, *names: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.concat_ws(" ", *(x[n] for n in names))), ", ").alias(c)
    rows = rules.nested(rules_, conditions, actions)
    return rows.select("rule_id", "rule_name", text("conditions", "metric_name", "operator", "value_from"), text("actions", "action_id", "action_type"))


HIT = "contains(lower({}), 'er')"


@query(
    with_tables("facts", "questions", "topics", "imports", "criteria", "answers")
    + f"""SELECT entity_type, entity_id, content FROM (
  (SELECT 0 AS o, 'question' AS entity_type, question_id AS entity_id, substr(question_text, 1, 200) AS content FROM questions WHERE {HIT.format('question_text')} ORDER BY 3 LIMIT 2)
  UNION ALL (SELECT 1, 'topic', syllabus_topic_id::BIGINT, title FROM topics WHERE {HIT.format('title')} OR {HIT.format('keywords')} ORDER BY 3 LIMIT 2)
  UNION ALL (SELECT 2, 'discipline', NULL, discipline_name FROM (SELECT DISTINCT discipline_name FROM topics) WHERE {HIT.format('discipline_name')} LIMIT 2)
  UNION ALL (SELECT 3, 'import', import_id, source_filename FROM imports WHERE {HIT.format('source_filename')} OR {HIT.format('import_type')} ORDER BY 3 LIMIT 2)
  UNION ALL (SELECT 4, 'rule', 1, 'er rule')
  UNION ALL (SELECT 5, 'criteria', criteria_id, name FROM criteria WHERE {HIT.format('name')} ORDER BY 3 LIMIT 2)
  UNION ALL (SELECT 6, 'answer', answer_id, substr(answer_text, 1, 200) FROM answers WHERE {HIT.format('answer_text')} OR {HIT.format('work_id')} ORDER BY 3 LIMIT 2))"""
)
def search_keyword(t: Tables):
    """The two first hits of a search in each of seven kinds of entity, a top-k report."""
    rules_ = t.spark.createDataFrame([(1, "er rule", True), (2, "plain", True)], "rule_id int, rule_name string, is_active boolean")
    sources = searching.word_sources(t.questions(), t.topics(), t.imports(), rules_, t.criteria(), t.answers())
    parts = [searching.by_words({kind: source}, "er", 2) for kind, source in sources.items()]
    number = F.when(F.col("entity_type") != "discipline", F.col("entity_id"))  # a checksum of the name, which SQL lacks
    return reduce(DataFrame.unionAll, parts).select("entity_type", number.alias("entity_id"), "content")


@query(
    with_tables("facts", "questions", "topics", "imports", "criteria", "answers")
    + f"""SELECT 'question' AS entity_type, question_id AS entity_id, question_text AS content, to_json({{'discipline': discipline_name, 'topic': title,
    'validation_status': NULL, 'alignment_level': NULL, 'avg_score': a, 'attempts': n}})::VARCHAR AS meta FROM questions LEFT JOIN topics USING (syllabus_topic_id)
  LEFT JOIN (SELECT question_id, {r('avg(received_score)', 1)} AS a, count(*) AS n FROM facts GROUP BY 1) USING (question_id) WHERE question_id = 2
UNION ALL SELECT 'topic', syllabus_topic_id::BIGINT, title, to_json({{'discipline': discipline_name}})::VARCHAR FROM topics WHERE syllabus_topic_id = 2
UNION ALL SELECT 'student', student_id, 'Студент #' || student_id, to_json({{'avg': {r('avg(received_score)', 2)}, 'min': min(received_score), 'max': max(received_score),
    'n_items': count(*)}})::VARCHAR FROM facts WHERE student_id = 2 GROUP BY student_id
UNION ALL SELECT 'import', import_id, source_filename, to_json({{'type': import_type, 'rows': rows_imported}})::VARCHAR FROM imports WHERE import_id = 2
UNION ALL SELECT 'exam', exam_id, 'Экзамен #' || exam_id, to_json({{'students': count(DISTINCT student_id), 'attempts': count(*)}})::VARCHAR FROM facts WHERE exam_id = 2 GROUP BY exam_id
UNION ALL SELECT 'rule', 2, 'easy', '{{"active":true}}'
UNION ALL SELECT 'answer', answer_id, substr(answer_text, 1, 200), to_json({{'work_id': work_id, 'lang': language, 'score': final_score, 'penalty': plagiarism_penalty}})::VARCHAR
  FROM answers WHERE answer_id = 2"""
)
def search_by_id(t: Tables):
    """What has the number 2, in eight kinds of entity."""
    sources = searching.entity_sources(t.facts(), t.questions(), t.topics(), t.imports(), _rules(t)[0], t.criteria(), t.answers())
    return searching.search("2", sources, {}).select("entity_type", "entity_id", "content", "meta")


@query(
    with_tables("questions", "topics")
    + """SELECT entity_type, entity_id, content, content AS to_embed FROM (
  SELECT 'question' AS entity_type, question_id AS entity_id, question_text AS content FROM questions WHERE question_id % 4 <> 0
  UNION ALL SELECT 'topic', syllabus_topic_id::BIGINT, title || ' ' || keywords FROM topics)"""
)
def search_index_refresh(t: Tables):
    """Entries that aren't in the index, which has each fourth question."""
    existing = t.questions().where("question_id % 4 = 0").select(F.lit("question").alias("entity_type"), F.col("question_id").alias("entity_id"))
    return searching.index_entries(t.questions(), t.topics(), existing)


@query(
    with_tables("facts", "questions", "topics")
    + """SELECT import_id, question_id, question_text, discipline, title, title IS NOT NULL AS is_linked FROM
  (SELECT import_id, question_id, max(discipline_name) AS discipline FROM facts GROUP BY 1, 2)
  JOIN questions USING (question_id) LEFT JOIN (SELECT syllabus_topic_id, title FROM topics) USING (syllabus_topic_id)"""
)
def link_list(t: Tables):
    return dashboards.link_list(t.facts(), t.questions(), t.topics())


LINKS = """links AS (SELECT import_id, question_id, syllabus_topic_id IS NOT NULL AS is_linked FROM (SELECT DISTINCT import_id, question_id FROM facts)
  JOIN questions USING (question_id) WHERE contains(lower(question_text), 'e'))"""


@query(
    with_tables("facts", "questions", more=LINKS)
    + """SELECT import_id, count(*) AS questions, count(*) FILTER (WHERE is_linked) AS linked, count(*) FILTER (WHERE NOT is_linked) AS unlinked FROM links GROUP BY 1"""
)
def link_counts(t: Tables):
    """Of the questions with an e in their text."""
    links = dashboards.link_list(t.facts(), t.questions(), t.topics())
    return dashboards.link_counts(dashboards.filtered(links, "E", ["question_text"]))


@query(
    with_tables("facts", "questions", "topics")
    + """SELECT question_id, question_text, discipline, title, title IS NOT NULL AS is_linked FROM (SELECT question_id, max(discipline_name) AS discipline FROM facts GROUP BY 1)
  JOIN questions USING (question_id) LEFT JOIN (SELECT syllabus_topic_id, title FROM topics) USING (syllabus_topic_id) WHERE title IS NULL"""
)
def link_list_unscoped(t: Tables):
    """Unlinked questions, whatever their imports."""
    return dashboards.filtered(dashboards.link_list(t.facts(), t.questions(), t.topics(), by_import=False), is_linked=False)


@query(
    """SELECT p_partkey AS question_id, p_type AS rubric_title, CASE WHEN contains(lower(p_name || ' ' || p_type), 'ring') THEN 1 ELSE 0 END
  + CASE WHEN contains(lower(p_name || ' ' || p_type), 'eco') THEN 1 ELSE 0 END AS overlap,
  concat_ws(',', CASE WHEN p_partkey % 2 = 1 THEN 'SHORT_TEXT' END, CASE WHEN p_type LIKE '%STEEL' AND p_partkey % 3 <> 0 THEN 'DOSES_STRESSED' END) AS issues FROM part"""
)
def rubric_compliance(t: Tables):
    """Parts as questions, each second one long, each third one on a dose; rubrics of steel have a note on doses."""
    part, key, kind = t.read("part"), F.col("p_partkey"), F.col("p_type")
    long = F.when(key % 2 == 0, " and so on, until the wording is long enough to be clear").otherwise("")
    text = F.concat("p_name", F.lit(" "), "p_type", F.when(key % 3 == 0, " 5 МГ").otherwise(" амг, недоз"), long)
    questions = part.select(key.alias("question_id"), text.alias("question_text"), kind.alias("rubric_id"))
    note = F.when(kind.endswith("STEEL"), "doses").otherwise("").alias("dose_theme_note")
    rubrics = part.select(kind.alias("rubric_id"), kind.alias("title"), F.lit("Ring\n\n eco ").alias("criteria_text"), note).distinct()
    return aligned.rubric_compliance(questions, rubrics)


NUMBERED = """SELECT p_brand AS discipline, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS position, p_name || chr(10) || p_type AS text FROM part"""


def _numbered(t: Tables) -> DataFrame:
    """Each brand's parts as a text of numbered questions."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = t.read("part").select("p_brand", n.alias("n"), F.concat(n.cast("string"), F.lit(". "), "p_name", F.lit("\n"), "p_type").alias("x"))
    rows = rows.groupBy(F.col("p_brand").alias("discipline"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]), "\n\n").alias("text"))


@query(NUMBERED)
def question_texts(t: Tables):
    """Numbered questions, parsed back."""
    from ..functions.parsing import numbered_questions

    rows = _numbered(t).select("discipline", F.posexplode(numbered_questions(F.col("text"))))
    return rows.select("discipline", (F.col("pos") + 1).alias("position"), F.col("col").alias("text"))


@query(NUMBERED)
def question_texts_lateral(t: Tables):
    """The same by a table function in SQL."""
    from ..functions.parsing import register_parsers

    register_parsers(t.spark)
    return t.spark.sql("SELECT d.discipline, q.position, q.text FROM {docs} d, LATERAL numbered_questions(d.text) q", docs=_numbered(t))


@query(
    """SELECT p_brand AS discipline, upper(substr(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'), 1, 6)) || '_T' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS code,
  'topic of ' || p_name || ' ' || p_partkey AS title FROM part"""
)
def syllabus_topics(t: Tables):
    """Each brand's parts as a course plan, its topics parsed back."""
    from ..functions.parsing import syllabus_topics as parsed

    line = F.concat(F.lit("1.\n12 30\nмоodle moodle\n"), F.lit("topic of "), "p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    rows = t.read("part").select("p_brand", "p_partkey", line.alias("x")).groupBy(F.col("p_brand").alias("discipline"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "x"))), lambda s: s["x"]), "\n")
    rows = rows.agg(F.concat(F.lit("Course\nТематический план\n"), text, F.lit("\nВсего: 9")).alias("text"))
    topics = parsed(rows, "text", "discipline").select("discipline", F.explode("topics").alias("t"))
    return topics.select("discipline", "t.code", "t.title")
