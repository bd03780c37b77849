"""Queries on changes of tables, imports and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..adapters import Tables, with_tables
from ..coefficients import resolve_overrides
from ..operators import dashboards, imports, items, store
from ..operators.commits import Store

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


EXISTING = "existing AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1)"


def _existing(t: Tables):
    return t.read("orders").where("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v"))


def _new(t: Tables):
    return t.read("orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") + 1_000_000).alias("v"), F.col("o_orderkey").alias("seq"))


@query(
    f"""WITH {EXISTING} SELECT * FROM existing UNION ALL
SELECT o_custkey, min(o_orderkey) + 1000000 FROM orders WHERE o_custkey NOT IN (SELECT k FROM existing) GROUP BY 1"""
)
def insert_ignore(t: Tables):
    return store.insert_ignore(_existing(t), _new(t), ["k"], "seq")


@query(f"WITH {EXISTING} SELECT o_custkey AS k, max(o_orderkey) + 1000000 AS v FROM orders GROUP BY 1")
def upsert_latest(t: Tables):
    return store.upsert(_existing(t), _new(t), ["k"], "seq")


@query(f"WITH {EXISTING} SELECT k, CASE WHEN k % 2 = 0 THEN -k ELSE v END AS v FROM existing")
def update_by_key(t: Tables):
    changes = _existing(t).where("k % 2 = 0").select("k", (-F.col("k")).alias("v"))
    return store.update(_existing(t), changes, ["k"])


@query(f"WITH {EXISTING} SELECT * FROM existing WHERE k % 5 <> 0")
def delete_by_key(t: Tables):
    return store.delete(_existing(t), t.read("customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k")), ["k"])


@query(f"WITH {EXISTING} SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT k FROM existing)")
def anti_new_keys(t: Tables):
    return store.delete(_new(t).select("k").distinct(), _existing(t).select("k"), ["k"])


@query(
    with_tables("facts")
    + "SELECT student_id || '_' || question_id AS work_id, student_id, question_id, min(import_id) AS import_id FROM facts GROUP BY 2, 3"
)
def derived_work_mapping(t: Tables):
    return store.work_mapping(t.facts())


@query(with_tables("questions") + "SELECT question_id, CASE WHEN question_id % 10 = 0 THEN 7 ELSE syllabus_topic_id END AS syllabus_topic_id FROM questions")
def link_to_topic(t: Tables):
    rows = t.questions()
    return store.linked(rows, rows.where("question_id % 10 = 0"), 7).select("question_id", "syllabus_topic_id")


@query(
    with_tables("facts", "questions")
    + """, linked AS (SELECT DISTINCT import_id, question_id FROM facts JOIN questions USING (question_id) WHERE syllabus_topic_id IS NOT NULL),
cached AS (SELECT * FROM linked WHERE import_id = 1 OR question_id % 2 = 0)
SELECT import_id, (SELECT count(*) FROM cached c WHERE c.import_id = i.import_id) > 0
  AND NOT EXISTS (SELECT question_id FROM linked l WHERE l.import_id = i.import_id EXCEPT SELECT question_id FROM cached c WHERE c.import_id = i.import_id) AS valid
FROM (SELECT DISTINCT import_id FROM facts) i"""
)
def cache_validity(t: Tables):
    """The cache has all items of the first import, and lacks some of the others'."""
    linked = t.facts().join(t.questions().where("syllabus_topic_id IS NOT NULL"), "question_id").select("import_id", "question_id")
    cached = linked.distinct().where("import_id = 1 OR question_id % 2 = 0")
    return store.cache_is_valid(cached, linked)


@query(
    with_tables("facts", "questions")
    + """SELECT 'changed' AS what, count(*) AS n FROM questions WHERE question_id % 10 = 0 AND syllabus_topic_id IS DISTINCT FROM 7
UNION ALL SELECT 'linked to 7', count(*) FROM questions WHERE question_id % 10 = 0 OR syllabus_topic_id = 7
UNION ALL SELECT 'cached', count(*) FROM (SELECT DISTINCT import_id, question_id FROM facts) WHERE import_id <> 2"""
)
def link_and_invalidate(t: Tables):
    """Each tenth question linked to a topic; the second import's cache goes."""
    rows, cache = t.questions(), t.facts().select("import_id", "question_id").distinct()
    after, changed, caches = store.link_and_invalidate(rows, rows.where("question_id % 10 = 0"), 7, {"validation": cache}, 2)
    parts = [
        t.spark.createDataFrame([("changed", changed)], "what string, n long"),
        after.where("syllabus_topic_id = 7").agg(F.lit("linked to 7").alias("what"), F.count("*").alias("n")),
        caches["validation"].agg(F.lit("cached").alias("what"), F.count("*").alias("n")),
    ]
    return reduce(DataFrame.unionAll, parts)


@query(
    with_tables("facts")
    + """SELECT import_id, question_id, CASE WHEN import_id = 2 THEN 'new' ELSE 'old' END AS status FROM (SELECT DISTINCT import_id, question_id FROM facts)
WHERE import_id <> 2 OR question_id % 2 = 0"""
)
def cache_rebuilt(t: Tables):
    rows = t.facts().select("import_id", "question_id").distinct()
    fresh = rows.where("question_id % 2 = 0").withColumn("status", F.lit("new"))
    return store.rebuilt(rows.withColumn("status", F.lit("old")), fresh, 2)


@query(
    """SELECT CASE WHEN n_nationkey > 0 THEN n_nationkey END AS criteria_id, n_name AS name_kazakh, CASE WHEN n_nationkey % 2 = 0 THEN 'ru ' || n_name ELSE n_name END AS name_russian,
  n_name AS name_english, n_regionkey * 10 + 0.5::DOUBLE AS weight_percent, n_nationkey > 0 AND n_regionkey > 0 AS is_kept
FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation)"""
)
def import_criteria(t: Tables):
    """Nations as a table of criteria without known headers; the weight is below half a percent for the first region."""
    key = F.col("n_nationkey")
    weight = F.concat((F.col("n_regionkey") * 10).cast("string"), F.lit(",5 %"))
    rows = t.read("nation").select(
        F.when(key > 0, key.cast("string")).otherwise("-").alias("a"), F.col("n_name").alias("b"), F.when(key % 2 == 0, F.concat(F.lit("ru "), "n_name")).otherwise(" - ").alias("c"),
        F.lit("").alias("d"), F.when(F.col("n_regionkey") > 0, weight).otherwise("-0,5").alias("e"),
    )
    out = imports.criteria(imports.criteria_columns(rows))
    return out.withColumn("weight_percent", F.abs("weight_percent"))


@query(
    """SELECT user_id || '' AS work_id, ascii(event_type) * 1000 + length(event_type) AS criteria_id, max_by(value, event_id) AS score FROM events
WHERE value BETWEEN 0 AND 100 AND event_type <> 'error' GROUP BY 1, 2 UNION ALL SELECT 'kept', 1, 5.0"""
)
def import_details_upserted(t: Tables):
    """The last score of each user's event as the evaluation of a work."""
    rows = t.read("events").select(
        F.col("user_id").cast("string").alias("work_id"), (F.ascii("event_type") * 1000 + F.length("event_type")).cast("string").alias("criteria_id"),
        F.col("value").cast("string").alias("score"), "event_id",
    )
    new = imports.evaluation_details(rows, t.criteria().where("name <> 'error'"), ["event_id"])
    existing = t.spark.createDataFrame([("kept", 1, 5.0)], "work_id string, criteria_id long, score double")
    return imports.upserted(existing, new, ["work_id", "criteria_id"], "event_id")


@query(
    """SELECT 'w' || doc_id AS work_id, 0::BIGINT AS student_id, 0::BIGINT AS question_id FROM documents WHERE doc_id % 3 = 1 AND doc_id % 4 <> 0
UNION ALL SELECT doc_id || '_1', doc_id, 0 FROM documents WHERE doc_id % 3 = 2 AND doc_id % 4 <> 0"""
)
def import_answers_works(t: Tables):
    """Works that answers name and that aren't known: each third document's is, each fourth has no answer."""
    key = F.col("doc_id")
    name = F.when(key % 3 == 2, F.concat(key.cast("string"), F.lit("_1"))).otherwise(F.concat(F.lit("w"), key.cast("string")))
    docs = t.read("documents").select(key, name.alias("work_id"))
    answers = docs.withColumn("outcome", F.when(key % 4 == 0, "invalid").otherwise("inserted"))
    return imports.missing_works(answers, docs.where("doc_id % 3 = 0"))


@query(
    with_tables("facts", "topics", "imports")
    + """SELECT * FROM (SELECT count(*) AS rows, count(DISTINCT question_id) AS questions, count(DISTINCT student_id) AS students, count(DISTINCT discipline_name) AS disciplines FROM facts),
  (SELECT count(*) AS topics, count(DISTINCT discipline_name) AS topic_disciplines FROM topics), (SELECT count(*) AS imports FROM imports)"""
)
def import_statistics(t: Tables):
    return dashboards.import_statistics(t.facts(), t.topics(), t.imports())


@query("SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS active, count(*) FILTER (WHERE n_name = 'CHINA') AS superadmins FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def user_totals(t: Tables):
    return dashboards.user_totals(QUERIES["user_report"](t.spark, t.dir), "CHINA")


@query(
    with_tables("topics")
    + """SELECT syllabus_topic_id, title FROM topics WHERE discipline_name IN (SELECT p_brand FROM part WHERE p_partkey % 7 = 0) ORDER BY 1 LIMIT 100"""
)
def topic_list(t: Tables):
    uploaded = t.read("part").where("p_partkey % 7 = 0").select(F.col("p_brand").alias("discipline_name"))
    return dashboards.topic_list(t.topics(), uploaded).select("syllabus_topic_id", "title")


@query(
    with_tables("facts")
    + """SELECT import_id, lag(import_id) OVER (ORDER BY created_at) AS previous_id FROM (SELECT DISTINCT import_id, -import_id AS created_at FROM facts)"""
)
def previous_imports(t: Tables):
    return dashboards.previous_imports(t.facts().select("import_id", (-F.col("import_id")).alias("created_at")).distinct())


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN l_quantity WHEN l_linenumber = 2 THEN l_tax WHEN l_linenumber = 3 THEN l_discount END::DOUBLE AS score FROM lineitem"""
)
def score_cascade(t: Tables):
    """Scores before and after appeal that are words for later lines, and of the discipline."""
    n, word = F.col("l_linenumber"), F.lit("none")
    own = lambda k, c: F.when(n == k, F.col(c).cast("string")).otherwise(word)
    return t.read("lineitem").select("l_orderkey", n, imports.score_cascade(own(1, "l_quantity"), own(2, "l_tax"), own(3, "l_discount")).alias("score"))


#: Line items as an imported file: strings with empty cells, dashes, decimal commas, fractions of ids.
RAW = """raw AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 5 THEN '' ELSE l_partkey || '.7' END AS question_id, CASE WHEN l_linenumber IN (4, 5) THEN '-' ELSE ' ' || l_orderkey END AS student_id,
  CASE WHEN l_linenumber = 1 THEN '' ELSE '2' END AS course, CASE WHEN l_linenumber = 2 THEN '-' ELSE replace(CAST(l_quantity AS VARCHAR), '.', ',') END AS score_after,
  CASE WHEN l_linenumber = 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE 'x' END AS score_before, l_returnflag AS discipline FROM lineitem)"""


def _raw(t: Tables, *also: str):
    n, quantity = F.col("l_linenumber"), F.col("l_quantity")
    return t.read("lineitem").select(
        F.when(n == 5, "").otherwise(F.concat(F.col("l_partkey").cast("string"), F.lit(".7"))).alias("\ufeffQuestion_ID"),
        F.when(n.isin(4, 5), "-").otherwise(F.concat(F.lit(" "), F.col("l_orderkey").cast("string"))).alias("ID студента"),
        F.when(n == 1, "").otherwise("2").alias("Kurs"),
        F.when(n == 2, "-").otherwise(F.replace(quantity.cast("string"), F.lit("."), F.lit(","))).alias("Оценка после апелляции"),
        F.when(n == 2, quantity.cast("int").cast("string")).otherwise("x").alias("Bedömning före överklagande"),
        F.col("l_returnflag").alias(" DISCIPLINE_NAME "), *also,
    )


TYPED = """typed AS (SELECT CASE WHEN l_linenumber <> 5 THEN CAST(split_part(question_id, '.', 1) AS BIGINT) END AS question_id,
  CASE WHEN l_linenumber NOT IN (4, 5) THEN l_orderkey END AS student_id, CASE WHEN l_linenumber <> 1 THEN 2 END AS course_number,
  CAST(CASE WHEN l_linenumber = 2 THEN score_before ELSE replace(score_after, ',', '.') END AS DOUBLE) AS received_score, discipline AS discipline_name,
  l_linenumber <> 5 AS is_kept, l_orderkey * 10 + l_linenumber AS seq FROM raw)"""


@query(f"WITH {RAW}, {TYPED} SELECT * EXCLUDE (seq) FROM typed")
def import_typed(t: Tables):
    rows = imports.exam_results(imports.named(_raw(t)))
    return rows.select("question_id", "student_id", "course_number", "received_score", "discipline_name", "is_kept")


@query(
    f"""WITH {RAW}, {TYPED} SELECT count(*) AS rows_total, count(*) FILTER (WHERE is_kept) AS rows_imported, count(*) FILTER (WHERE NOT is_kept) AS rows_rejected,
  count(DISTINCT question_id) FILTER (WHERE is_kept) AS questions, count(DISTINCT student_id) FILTER (WHERE is_kept) AS students FROM typed"""
)
def import_counts(t: Tables):
    return imports.import_counts(imports.exam_results(imports.named(_raw(t))))


#: What the tables hold after the imports of rows ``file, seq, ...`` one after the other: of each key the first row of the first file.
AFTER_IMPORTS = """
first_of AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY file, seq) AS of_question, row_number() OVER (PARTITION BY student_id ORDER BY file, seq) AS of_student,
  row_number() OVER (PARTITION BY student_id, question_id ORDER BY file, seq) AS of_work FROM kept)
SELECT 'results' AS target, student_id::VARCHAR AS a, question_id::VARCHAR AS b, discipline_name AS c, course_number, received_score AS score, file AS import_id FROM kept
UNION ALL SELECT kind, question_id::VARCHAR, NULL, '', NULL, 100.0, NULL FROM first_of, (VALUES ('questions single'), ('hier_questions single_choice')) k(kind) WHERE question_id <> 0 AND of_question = 1
UNION ALL SELECT 'students', student_id::VARCHAR, NULL, NULL, coalesce(course_number, 3), NULL, NULL FROM first_of WHERE student_id <> 0 AND of_student = 1
UNION ALL SELECT 'works', student_id || '_' || question_id, question_id::VARCHAR, discipline_name, coalesce(course_number, 3), NULL, file FROM first_of WHERE student_id <> 0 AND question_id <> 0 AND of_work = 1
UNION ALL SELECT DISTINCT 'topics', 'AUTO_' || md5(discipline_name), discipline_name, lower(discipline_name), 3, NULL::DOUBLE, NULL::BIGINT FROM kept
UNION ALL SELECT 'log', 'results_' || file || '.csv', count(*)::VARCHAR, count(*) FILTER (WHERE NOT is_kept)::VARCHAR, NULL, count(*) FILTER (WHERE is_kept), file FROM files GROUP BY file"""


def _imported(t: Tables, *files: str):
    """The rows of all tables after the imports of the lines that each condition selects."""
    tables = Store(t.spark, store.shared_path(t.spark, "imports"), imports.EXAM_TABLES)
    for k, condition in enumerate(files, 1):
        rows = _raw(t, "l_orderkey", "l_linenumber").where(condition)
        rows = rows.withColumn("order", F.col("l_orderkey") * 10 + F.col("l_linenumber")).drop("l_orderkey", "l_linenumber")
        imports.import_exam(tables, rows, f"results_{k}.csv", "csv", order="order")
    none = F.lit(None)
    columns = {
        "results": ("results", "student_id", "question_id", "discipline_name", "course_number", "received_score", "import_id"),
        "questions": (F.concat(F.lit("questions "), "question_type"), "question_id", none, "question_text", none, "max_score", none),
        "hier_questions": (F.concat(F.lit("hier_questions "), "question_type"), "question_id", none, "question_text", none, "max_score", none),
        "students": ("students", "student_id", none, none, "course_number", none, none),
        "works": ("works", "work_id", "question_id", "discipline_name", "course_number", none, "import_id"),
        "topics": ("topics", "topic_code", "title", "keywords", "course_number", none, none),
        "log": ("log", "source_filename", "rows_total", "rows_rejected", none, "rows_imported", "import_id"),
    }
    kinds = {"target": "string", "a": "string", "b": "string", "c": "string", "course_number": "int", "score": "double", "import_id": "long"}
    parts = []
    for name, (target, *values) in columns.items():
        target = F.lit(target) if isinstance(target, str) else target
        values = [F.col(v) if isinstance(v, str) else v for v in values]
        parts.append(tables.read(name).select(*(v.cast(kind).alias(c) for (c, kind), v in zip(kinds.items(), [target, *values], strict=True))))
    return reduce(DataFrame.unionAll, parts)


@query(f"WITH {RAW}, {TYPED}, files AS (SELECT 1::BIGINT AS file, * FROM typed), kept AS (SELECT * FROM files WHERE is_kept), {AFTER_IMPORTS}")
def import_tables(t: Tables):
    """What an import of exam results makes of its empty tables."""
    return _imported(t, "true")


@query(
    f"""WITH {RAW}, {TYPED}, files AS (SELECT 1::BIGINT AS file, * FROM typed WHERE (seq // 10) % 3 <> 0 AND seq % 10 > 1
  UNION ALL SELECT 2::BIGINT AS file, * FROM typed WHERE (seq // 10) % 3 <> 1), kept AS (SELECT * FROM files WHERE is_kept), {AFTER_IMPORTS}"""
)
def import_twice(t: Tables):
    """The tables after two imports with students, questions and works in common."""
    return _imported(t, "l_orderkey % 3 <> 0 AND l_linenumber > 1", "l_orderkey % 3 <> 1")


@query(
    """SELECT DISTINCT l_returnflag AS discipline_name, 3 AS course_number, 'AUTO_' || md5(l_returnflag) AS topic_code, l_returnflag AS title, lower(l_returnflag) AS keywords
FROM lineitem"""
)
def auto_topics(t: Tables):
    rows = imports.exam_results(imports.named(_raw(t))).withColumn("seq", F.lit(0))
    return imports.auto_topics(rows.where("is_kept")).drop("seq")


@query(
    """SELECT CASE WHEN value < 0 OR value > 100 THEN 'skipped' WHEN event_type = 'error' THEN 'invalid' ELSE 'inserted' END AS outcome, count(*) AS n
FROM events GROUP BY 1"""
)
def import_details(t: Tables):
    rows = t.read("events").select(
        F.col("user_id").cast("string").alias("work_id"), (F.ascii("event_type") * 1000 + F.length("event_type")).cast("string").alias("criteria_id"),
        F.col("value").cast("string").alias("score"),
    )
    known = t.criteria().where("name <> 'error'")
    return imports.evaluation_details(rows, known).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    """WITH sent AS (SELECT 1 AS file, event_id, user_id, event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 2, event_id, user_id, event_type, value FROM events WHERE event_id % 3 = 0),
judged AS (SELECT *, CASE WHEN value < 0 OR value > 100 THEN 'skipped' WHEN event_type = 'error' THEN 'invalid' ELSE 'inserted' END AS outcome FROM sent)
SELECT 'evaluation' AS target, user_id || '' AS a, (ascii(event_type) * 1000 + length(event_type)) || '' AS b, max_by(value, file * 1000000000000 + event_id) AS score FROM judged
WHERE outcome = 'inserted' GROUP BY 2, 3
UNION ALL SELECT 'count ' || file, outcome, NULL, count(*) FROM judged GROUP BY file, outcome
UNION ALL SELECT 'log', file || '.csv', count(*) || '', count(*) FILTER (WHERE outcome = 'inserted') FROM judged GROUP BY file"""
)
def import_evaluations(t: Tables):
    """Two imports of evaluations, the second over the first: the table, the observed counters and the log."""
    tables = Store(t.spark, store.shared_path(t.spark, "evaluations"), imports.EVALUATION_TABLES)
    rows = t.read("events").select(
        F.col("user_id").cast("string").alias("work_id"), (F.ascii("event_type") * 1000 + F.length("event_type")).cast("string").alias("criteria_id"),
        F.col("value").cast("string").alias("score"), "event_id",
    )
    known = t.criteria().where("name <> 'error'")
    counts = [imports.import_evaluations(tables, rows.where(f"event_id % {k + 1} = 0"), known, f"{k}.csv", "event_id") for k in (1, 2)]
    counters = [(f"count {k}", name, None, float(n)) for k, c in enumerate(counts, 1) for name, n in c.items() if name != "total" and n]
    log = tables.read("log").select(F.lit("log"), "source_filename", F.col("rows_total").cast("string"), F.col("rows_imported").cast("double"))
    out = tables.read("evaluations").select(F.lit("evaluation").alias("target"), F.col("work_id").alias("a"), F.col("criteria_id").cast("string").alias("b"), "score")
    return out.union(t.spark.createDataFrame(counters, out.schema)).union(log)


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'invalid' WHEN doc_id % 5 = 0 THEN 'decode_error' ELSE 'inserted' END AS outcome,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN NULL ELSE text END AS answer_text FROM documents"""
)
def import_answers(t: Tables):
    docs = t.read("documents")
    coded = F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 5 == 0, "not*base64").otherwise(F.base64(F.col("text").cast("binary")))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("work_id"), F.col("lang").alias("language"), F.lit("question").alias("question"), coded.alias("answer"),
        F.lit("7,5").alias("score"), F.lit(None).cast("string").alias("comment"), F.lit("").alias("penalty"),
    )
    out = imports.student_answers(rows)
    text = F.when(F.col("outcome") == "inserted", F.col("answer_text"))
    return out.select(F.col("work_id").cast("long").alias("doc_id"), "outcome", text.alias("answer_text"))


@query(
    """SELECT a.l_returnflag AS import_id, a.position, a.l_partkey AS question_id, b.p_name AS text FROM
  (SELECT l_returnflag, l_partkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) AS position FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem)) a
  JOIN (SELECT f.l_returnflag, p_name, row_number() OVER (PARTITION BY f.l_returnflag ORDER BY p_partkey DESC) AS position FROM part, (SELECT DISTINCT l_returnflag FROM lineitem) f WHERE p_partkey % 2 = 0) b
  USING (l_returnflag, position)"""
)
def positional_zip(t: Tables):
    flags = t.read("lineitem").select("l_returnflag").distinct()
    left = t.read("lineitem").select("l_returnflag", F.col("l_partkey").alias("question_id")).distinct()
    right = t.read("part").where("p_partkey % 2 = 0").crossJoin(F.broadcast(flags)).select("l_returnflag", "p_partkey", F.col("p_name").alias("text"))
    rows = imports.by_position(left, ["question_id"], right, [F.desc("p_partkey")], ["l_returnflag"])
    return rows.select(F.col("l_returnflag").alias("import_id"), "position", "question_id", "text")


@query(
    """SELECT event_id AS log_id, user_id, c_name AS user_name, event_type AS action_type, ts AS created_at FROM events LEFT JOIN customer ON user_id = c_custkey
ORDER BY ts DESC, event_id DESC LIMIT 100"""
)
def audit_report(t: Tables):
    return dashboards.audit_report(_logs(t), t.read("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name")))


def _logs(t: Tables):
    return t.read("events").select(F.col("event_id").alias("log_id"), "user_id", F.col("event_type").alias("action_type"), F.col("ts").alias("created_at"))


@query("SELECT event_type AS action_type, count(*) AS total, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-02') AS today FROM events GROUP BY 1")
def audit_totals(t: Tables):
    return dashboards.audit_totals(_logs(t), "2024-01-02")


@query("SELECT c_custkey AS user_id, c_name AS user_name, n_name AS role_name, c_acctbal > 0 AS is_active FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def user_report(t: Tables):
    users = t.read("customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("c_nationkey").alias("role_id"), (F.col("c_acctbal") > 0).alias("is_active")
    )
    return dashboards.user_report(users, t.read("nation").select(F.col("n_nationkey").alias("role_id"), F.col("n_name").alias("role_name")))


@query(with_tables("facts") + "SELECT DISTINCT import_id, discipline_name FROM facts WHERE discipline_name <> ''")
def disciplines(t: Tables):
    return dashboards.disciplines(t.facts())


@query(
    """SELECT s_suppkey AS log_id, CASE WHEN s_nationkey % 5 = 0 THEN 0.5::DOUBLE WHEN s_nationkey % 3 = 0 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS coef_value FROM supplier"""
)
def coefficient_overrides(t: Tables):
    """Suppliers' thresholds: by nation as the discipline, else as the specialty, else the global one."""
    nation = t.read("nation").select("n_nationkey")
    own = lambda scope, k, v: nation.where(f"n_nationkey % {k} = 0").select(
        F.lit(scope).alias("scope_type"), F.col("n_nationkey").cast("string").alias("scope_value"), F.lit("quality").alias("category"),
        F.lit("easy").alias("coef_key"), F.lit(v).alias("coef_value"))
    overrides = own("discipline", 5, 0.5).union(own("specialty", 3, 0.7))
    everywhere = nation.where("n_nationkey = 0").select(F.lit("global"), F.lit(None).cast("string"), F.lit("quality"), F.lit("easy"), F.lit(0.9))
    nation_of = F.col("s_nationkey").cast("string")
    subjects = t.read("supplier").select(
        F.col("s_suppkey").alias("log_id"), nation_of.alias("discipline"), nation_of.alias("specialty"), F.lit("quality").alias("category"), F.lit("easy").alias("coef_key")
    )
    return resolve_overrides(overrides.union(everywhere), subjects).select("log_id", "coef_value")


@query(
    with_tables("facts", "questions")
    + """SELECT question_id, p_brand AS discipline, attempts FROM (SELECT p_partkey AS question_id, p_brand FROM part)
LEFT JOIN (SELECT question_id, count(*) AS attempts FROM facts GROUP BY 1) USING (question_id)"""
)
def question_list(t: Tables):
    part = t.read("part").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("discipline_id"))
    names = part.select("discipline_id", F.col("discipline_id").alias("discipline")).distinct()
    metrics = items.scored(t.facts()).groupBy("question_id").agg(F.count("*").alias("attempts"))
    return dashboards.question_list(part, names, metrics).select("question_id", "discipline", "attempts")
