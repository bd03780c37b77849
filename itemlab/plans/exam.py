"""Queries on items, students, reliability and criteria."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import Tables, with_tables
from ..operators import criteria, dashboards, items, paging, reliability, store, students

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(x: str, digits: int) -> str:
    """SQL of functions.stats.rounded."""
    return f"CAST(round(CAST({x} AS DECIMAL(18,{8 if digits >= 4 else 6})), {digits}) AS DOUBLE)"


MEANS = """means AS (SELECT import_id, f.question_id, count(*) AS n, avg(received_score) AS mean,
  coalesce(stddev_samp(received_score), 0) AS std, avg(CASE WHEN received_score >= 60 THEN 1.0::DOUBLE ELSE 0 END) AS passed,
  avg(received_score) / coalesce(nullif(max(max_score), 0), 100) AS ratio
  FROM facts f LEFT JOIN questions q ON f.question_id = q.question_id GROUP BY 1, 2)"""
FLAG = "CASE WHEN ratio >= 0.8 THEN 'too_easy' WHEN ratio <= 0.3 THEN 'too_hard' ELSE 'normal' END"
QUALITY = f"""quality AS (SELECT import_id, question_id, n, {r('mean', 2)} AS mean_score, {r('std', 2)} AS std_score,
  {r('passed', 3)} AS p_correct, {r('100 * (1 - ratio)', 1)} AS difficulty_pct, {FLAG} AS flag FROM means)"""


@query(with_tables("facts", "questions", more=MEANS + ",\n" + QUALITY) + "SELECT * FROM quality")
def item_quality(t: Tables):
    return items.item_quality(t.facts(), t.questions())


def correlation(x: str, y: str, least: int, epsilon: float) -> str:
    top = f"sum({x} * {y}) - sum({x}) * sum({y}) / count(*)"
    bottom = "sqrt(" + " * ".join(f"greatest(sum({v} * {v}) - sum({v}) * sum({v}) / count(*), 0)" for v in (x, y)) + ")"
    return f"CASE WHEN count(*) < {least} OR {bottom} <= {epsilon} THEN 0 ELSE ({top}) / {bottom} END"


TOTAL = f"""rest AS (SELECT import_id, question_id, received_score AS x,
  sum(received_score) OVER (PARTITION BY import_id, student_id) - received_score AS y FROM facts),
correlated AS (SELECT import_id, question_id, {r(correlation('x', 'y', 4, 1e-9), 4)} AS r FROM rest GROUP BY 1, 2)"""


@query(with_tables("facts", more=TOTAL) + "SELECT *, CASE WHEN abs(r) < 0.12 THEN 'low_corr' ELSE 'ok' END AS flag FROM correlated")
def item_total_correlation(t: Tables):
    return items.item_total_correlation(t.facts())


def index_sql(least: int) -> str:
    return f"""ability AS (SELECT student_id, avg(received_score) AS y FROM facts GROUP BY 1),
indexed AS (SELECT question_id, count(*) AS attempts, {r(correlation('received_score', 'y', 2, 0), 3)} AS discrimination
  FROM facts JOIN ability USING (student_id) GROUP BY 1 HAVING count(*) >= {least}),
discriminated AS (SELECT DISTINCT f.import_id, f.question_id, discrimination,
  CASE WHEN discrimination >= 0.4 THEN 'strong' WHEN discrimination >= 0.2 THEN 'medium' ELSE 'weak' END AS label
  FROM facts f JOIN indexed USING (question_id))"""


@query(with_tables("facts", more=index_sql(9)) + "SELECT * FROM discriminated")
def discrimination_index(t: Tables):
    return items.discrimination_index(t.facts())


METRICS = f"""metrics AS (SELECT q.question_id, {r('coalesce(mean, 0)', 2)} AS avg_score,
  CASE WHEN n IS NULL THEN 0 ELSE {r('1 - coalesce(mean, 0) / coalesce(nullif(max_score, 0), 100)', 3)} END AS difficulty_index,
  coalesce(discrimination, 0) AS discrimination_index, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reliability,
  coalesce(n, 0) AS total_attempts FROM questions q
  LEFT JOIN (SELECT question_id, avg(received_score) AS mean, count(*) AS n FROM facts GROUP BY 1) m USING (question_id)
  LEFT JOIN indexed USING (question_id))"""


@query(with_tables("facts", "questions", more=index_sql(2) + ",\n" + METRICS) + "SELECT * FROM metrics")
def question_metrics(t: Tables):
    return items.question_metrics(t.facts(), t.questions())


@query(
    with_tables("facts", "questions", more=",\n".join([MEANS, QUALITY, index_sql(9)]))
    + f"""SELECT q.import_id, q.question_id, {r('''40 * p_correct + greatest(least(coalesce(discrimination, 0), 30), 0)
  + 0.15::DOUBLE * (100 - difficulty_pct) - CASE WHEN flag <> 'normal' THEN 15 ELSE 0 END''', 1)} AS quality_score,
  CASE flag WHEN 'too_easy' THEN 'make_harder' WHEN 'too_hard' THEN 'revise' ELSE 'keep' END
  || CASE WHEN label = 'weak' THEN '+check_discrimination' ELSE '' END AS recommendation
FROM quality q LEFT JOIN discriminated d ON q.import_id = d.import_id AND q.question_id = d.question_id"""
)
def item_ranking(t: Tables):
    return items.item_ranking(t.facts(), t.questions())


@query(
    with_tables("facts", "questions", more=",\n".join([MEANS, QUALITY]))
    + f"""SELECT import_id, question_id, {r('100 * CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY import_id) AS DOUBLE)', 2)} AS weight_pct
FROM (SELECT *, CAST(greatest(least(difficulty_pct / 100, 1.5), 0.15) AS DECIMAL(18,6)) AS w FROM quality)"""
)
def item_weights(t: Tables):
    return items.item_weights(t.facts(), t.questions())


@query(
    with_tables("facts", "questions", more=MEANS)
    + """, gated AS (SELECT m.import_id, m.question_id, ratio >= 0.8 OR ratio <= 0.3 OR students < 5 AS flagged FROM means m
  JOIN (SELECT import_id, question_id, count(DISTINCT student_id) AS students FROM facts GROUP BY 1, 2) s
  ON m.import_id = s.import_id AND m.question_id = s.question_id)
SELECT import_id, question_id, flagged FROM (SELECT *, bool_or(flagged) OVER (PARTITION BY import_id) AS hot FROM gated)
WHERE flagged OR NOT hot"""
)
def stat_gate(t: Tables):
    return items.stat_gate(t.facts(), t.questions())


PER_STUDENT = """per_student AS (SELECT import_id, student_id, count(*) AS n, count(DISTINCT received_score) AS kinds,
  avg(received_score) AS mean, min(received_score) AS least, sum(received_score) AS total,
  coalesce(stddev_samp(received_score), 0) AS std FROM facts GROUP BY 1, 2)"""
RISK = f"""risk AS (SELECT import_id, student_id, {r('mean', 2)} AS avg_item, {r('least', 2)} AS min_item, {r('total', 2)} AS discipline_total,
  CASE WHEN systemic THEN 'systemic' WHEN spot THEN 'spot' ELSE 'ok' END AS pattern_type,
  concat_ws(',', CASE WHEN systemic THEN 'LOW_OVERALL' END, CASE WHEN spot AND NOT systemic THEN 'SINGLE_LOW_ITEM' END,
    CASE WHEN std < 4 AND n > 6 THEN 'UNIFORM_SCORES' END) AS notes
  FROM (SELECT p.*, mean < 50 AND total < median AS systemic, least < 20 AND mean > 65 AS spot FROM per_student p
  JOIN (SELECT import_id, median(total) AS median FROM per_student GROUP BY 1) m ON p.import_id = m.import_id))"""


@query(with_tables("facts", more=PER_STUDENT + ",\n" + RISK) + "SELECT * FROM risk")
def student_risk(t: Tables):
    return students.student_risk(t.facts())


@query(
    with_tables("facts", more=PER_STUDENT + ",\n" + RISK)
    + "SELECT * FROM risk ORDER BY avg_item DESC, import_id, student_id LIMIT 50 OFFSET 50"
)
def student_risk_page(t: Tables):
    """The second page of fifty students, by mean."""
    rows = paging.ordered(students.student_risk(t.facts()), ["import_id", "student_id"], ["avg_item", "min_item"], "avg_item", True)
    return paging.page(rows, 2)[0]


@query(
    with_tables("facts", more=PER_STUDENT)
    + "SELECT import_id, student_id, CASE WHEN mean < 50 THEN 'systemic' WHEN least < 20 THEN 'spot' ELSE 'ok' END AS pattern_type FROM per_student"
)
def risk_by_mean(t: Tables):
    return students.risk_by_mean(t.facts())


@query(with_tables("facts") + "SELECT import_id, count(DISTINCT student_id) AS students FROM facts GROUP BY 1")
def student_count(t: Tables):
    return students.student_count(t.facts())


@query(
    with_tables("facts", "profiles")
    + f"SELECT import_id, nationality_group, {r('avg(received_score)', 2)} AS avg_score, count(*) AS n FROM facts JOIN profiles USING (student_id) GROUP BY 1, 2"
)
def group_breakdown(t: Tables):
    return students.group_breakdown(t.facts(), t.profiles())


@query(
    with_tables("facts", more=PER_STUDENT)
    + """SELECT 'repeat_pattern' AS type, import_id, student_id, n AS detail, NULL::BIGINT AS question_id FROM per_student WHERE n > 5 AND kinds <= 2
UNION ALL SELECT 'flat_question', import_id, NULL, count(DISTINCT student_id), question_id FROM facts GROUP BY import_id, question_id
HAVING count(DISTINCT student_id) > 10 AND max(received_score) - min(received_score) < 3"""
)
def integrity_flags(t: Tables):
    return students.integrity_flags(t.facts())


@query(
    f"""WITH cells AS (SELECT l_returnflag AS exam_id, l_suppkey % 60 AS student_id, l_partkey % 6 AS question_id,
  CAST(round(avg(CAST(l_quantity + (l_suppkey % 60 % 11 - 5) * 2 AS DECIMAL(18,6))), 2) AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2, 3),
size AS (SELECT exam_id, count(DISTINCT question_id) AS k FROM cells GROUP BY 1),
complete AS (SELECT exam_id, student_id FROM cells JOIN size USING (exam_id) GROUP BY exam_id, student_id, k HAVING count(*) = k),
kept AS (SELECT * FROM cells JOIN complete USING (exam_id, student_id)),
pairs AS (SELECT a.exam_id, a.question_id AS q1, b.question_id AS q2,
  CAST({r(correlation('a.score', 'b.score', 2, 0), 3)} AS DECIMAL(10,3)) AS r FROM kept a JOIN kept b
  ON a.exam_id = b.exam_id AND a.student_id = b.student_id AND a.question_id < b.question_id GROUP BY 1, 2, 3),
means AS (SELECT exam_id, CAST(sum(r) AS DOUBLE) / count(*) AS m FROM pairs GROUP BY 1),
done AS (SELECT exam_id, k, students, {r('least(greatest(k * m / (1 + (k - 1) * m), 0), 1)', 3)} AS alpha, {r('m', 3)} AS avg_inter_item_r
  FROM size JOIN means USING (exam_id) JOIN (SELECT exam_id, count(*) AS students FROM complete GROUP BY 1) c USING (exam_id))
SELECT *, CASE WHEN alpha >= 0.9 THEN 'excellent' WHEN alpha >= 0.8 THEN 'good' WHEN alpha >= 0.7 THEN 'acceptable'
  WHEN alpha >= 0.6 THEN 'questionable' ELSE 'low' END AS interpretation FROM done"""
)
def exam_reliability(t: Tables):
    """Six items made of the parts, sixty students made of the suppliers, an exam for each return flag."""
    student = F.col("l_suppkey") % 60
    cells = t.read("lineitem").groupBy(
        F.col("l_returnflag").alias("exam_id"), student.alias("student_id"), (F.col("l_partkey") % 6).alias("question_id")
    )
    value = (F.col("l_quantity") + (student % 11 - 5) * 2).cast("decimal(18,6)")
    cells = cells.agg(F.round(F.avg(value), 2).cast("double").alias("score")).withColumn("seq", F.lit(1))
    return reliability.exam_reliability(cells)


LEVEL = "CASE WHEN avg(score) >= 85 THEN 'excellent' WHEN avg(score) >= 70 THEN 'good' WHEN avg(score) >= 50 THEN 'satisfactory' ELSE 'poor' END"


@query(
    with_tables("criteria", "details", "works")
    + f"""SELECT criteria_id, name, weight_percent::DOUBLE AS weight_percent, {r('avg(score)', 2)} AS avg_score, count(*) AS evaluations, min(score) AS min_score,
  max(score) AS max_score, {r('coalesce(stddev_samp(score), 0)', 2)} AS std_score, {LEVEL} AS performance_level
FROM details JOIN works USING (work_id) JOIN criteria USING (criteria_key) WHERE import_id = 2 GROUP BY criteria_id, name, weight_percent"""
)
def criteria_performance(t: Tables):
    return criteria.criteria_performance(t.details(), t.criteria(), t.works(), 2)


@query(
    with_tables("criteria", "details", "works")
    + f"""SELECT criteria_id, name, weight_percent::DOUBLE AS weight_percent, {r('avg(score)', 2)} AS avg_score, count(*) AS evaluations, min(score) AS min_score,
  max(score) AS max_score, {r('coalesce(stddev_samp(score), 0)', 2)} AS std_score, {LEVEL} AS performance_level
FROM details JOIN works USING (work_id) JOIN criteria USING (criteria_key) GROUP BY criteria_id, name, weight_percent"""
)
def criteria_performance_unscoped(t: Tables):
    """An import without evaluations: all of them count."""
    return criteria.criteria_performance(t.details(), t.criteria(), t.works(), 99)


@query(
    with_tables("answers")
    + f"""SELECT language, count(*) AS total_answers, {r('avg(final_score)', 2)} AS avg_score, {r('avg(plagiarism_penalty)', 2)} AS avg_penalty,
  count(*) FILTER (WHERE plagiarism_penalty > 0) AS plagiarism_count,
  {r('100.0::DOUBLE * count(*) FILTER (WHERE plagiarism_penalty > 0) / count(*)', 2)} AS plagiarism_rate FROM answers GROUP BY 1"""
)
def answers_by_language(t: Tables):
    return criteria.answers_by_language(t.answers())


@query(
    with_tables("criteria", "details", "works")
    + f"""SELECT question_id, string_agg(entry, ';' ORDER BY entry) AS criteria FROM (
  SELECT question_id, name || '=' || CAST(CAST(round(avg(score) * 100) AS BIGINT) AS VARCHAR) || '/' || count(*) AS entry
  FROM details JOIN works USING (work_id) JOIN criteria USING (criteria_key) GROUP BY question_id, name) GROUP BY 1"""
)
def criteria_by_question(t: Tables):
    rows = criteria.criteria_by_question(t.details(), t.criteria(), t.works())
    entry = lambda c: F.concat(c["name"], F.lit("="), F.round(c["avg"] * 100).cast("long"), F.lit("/"), c["evaluations"])
    return rows.select("question_id", F.array_join(F.array_sort(F.transform("criteria", entry)), ";").alias("criteria"))


CHANGE = """CASE WHEN {b} IS NULL OR {b} = 0 THEN 0 ELSE CAST(round(CAST(abs({x} - {b}) / CAST({b} AS DOUBLE) * 100 AS DECIMAL(18,6)), 1) AS DOUBLE) END AS {x}_change,
  {b} IS NULL OR {b} = 0 OR {x} >= {b} AS {x}_up"""


def _overview_sql(change: str) -> str:
    return with_tables("facts") + f"""SELECT import_id, questions, students, attempts, avg_score, {change.format(x='questions', b='bq')}, {change.format(x='students', b='bs')},
  {change.format(x='attempts', b='ba')}, {change.format(x='avg_score', b='bm')}
FROM (SELECT *, lag(questions) OVER w AS bq, lag(students) OVER w AS bs, lag(attempts) OVER w AS ba, lag(avg_score) OVER w AS bm FROM (
  SELECT import_id, count(DISTINCT question_id) AS questions, count(DISTINCT student_id) AS students, count(*) AS attempts,
    {r('avg(received_score)', 1)} AS avg_score FROM facts WHERE received_score > 20 GROUP BY 1) WINDOW w AS (ORDER BY import_id))"""


def _over_20(t: Tables):
    """The facts; scores up to 20 are taken as not given."""
    return t.facts().withColumn("received_score", F.when(F.col("received_score") > 20, F.col("received_score")))


@query(_overview_sql(CHANGE))
def overview(t: Tables):
    return dashboards.overview(_over_20(t))


@query(_overview_sql(CHANGE.replace("DECIMAL(18,6)), 1)", "DECIMAL(18,6)), 0)")))
def overview_whole(t: Tables):
    """Changes in whole percents."""
    return dashboards.overview(_over_20(t), 0)


@query(
    with_tables("facts", "questions")
    + f"""SELECT (SELECT count(DISTINCT import_id) FROM facts) AS total_documents, (SELECT greatest(0.1, {r('count(*) * 0.0005', 1)}) FROM facts) AS data_processed,
  (SELECT count(*) FROM questions WHERE syllabus_topic_id IS NOT NULL) AS active_questions, (SELECT count(*) FROM customer) AS team_members"""
)
def overview_totals(t: Tables):
    return dashboards.overview_totals(t.facts(), t.imports(), t.questions(), t.read("customer"))


@query(
    with_tables("facts", "questions", more=",\n".join([MEANS, QUALITY, TOTAL, PER_STUDENT, RISK]))
    + """SELECT import_id, 'quality' AS section, flag, count(*) AS n FROM quality GROUP BY 1, 3
UNION ALL SELECT import_id, 'correlation', CASE WHEN abs(r) < 0.12 THEN 'low_corr' ELSE 'ok' END, count(*) FROM correlated GROUP BY 1, 3
UNION ALL SELECT import_id, 'students', pattern_type, count(*) FROM risk GROUP BY 1, 3"""
)
def dashboard_tallies(t: Tables):
    facts, questions = t.facts(), t.questions()
    return dashboards.tallies({
        "quality": (items.item_quality(facts, questions), "flag"),
        "correlation": (items.item_total_correlation(facts), "flag"),
        "students": (students.student_risk(facts), "pattern_type"),
    })


@query(
    with_tables("facts")
    + f"""SELECT import_id, count(*) FILTER (WHERE received_score >= 60) AS passed, count(*) FILTER (WHERE received_score < 60) AS failed,
  {r('100.0::DOUBLE * count(*) FILTER (WHERE received_score >= 60) / count(*)', 1)} AS passed_pct FROM facts GROUP BY 1"""
)
def pass_fail(t: Tables):
    return dashboards.pass_fail(t.facts())


@query(
    with_tables("facts", "questions", more=MEANS + ",\n" + QUALITY)
    + """SELECT *, CASE flag WHEN 'too_hard' THEN 'danger' WHEN 'too_easy' THEN 'warning' ELSE 'success' END AS badge
FROM quality WHERE flag = 'too_hard' ORDER BY difficulty_pct DESC, import_id, question_id LIMIT 50"""
)
def section_page(t: Tables):
    """First page of the items with the badge danger, the most difficult first."""
    rows = items.item_quality(t.facts(), t.questions())
    rows = rows.withColumn("badge", paging.badge(F.col("flag"), ["too_hard"], ["too_easy"]))
    rows = paging.with_badge(rows, ["badge"], "danger")
    return paging.page(paging.ordered(rows, ["import_id", "question_id"], ["difficulty_pct"], "difficulty_pct", True), 1)[0]


#: Facts of which some rows have no score, question or student.
GAPS = """gaps AS (SELECT import_id, CASE WHEN raw_id % 29 <> 0 THEN question_id END AS question_id, CASE WHEN raw_id % 23 <> 0 THEN student_id END AS student_id,
  CASE WHEN raw_id % 17 <> 0 THEN received_score END AS received_score FROM facts)"""
#: Cached results of the first import's questions, and of the second's levels; the third has none.
CACHES = """validated AS (SELECT DISTINCT import_id, question_id, CASE question_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'warning' ELSE 'error' END AS status,
  CASE WHEN question_id % 10 > 0 THEN question_id % 10 / 10.0::DOUBLE END AS keyword_coverage FROM facts WHERE import_id = 1),
aligned AS (SELECT DISTINCT import_id, question_id, CASE question_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS alignment_level FROM facts WHERE import_id = 2)"""


@query(
    with_tables("facts", "questions", "answers", more=GAPS + ",\n" + CACHES)
    + f""", scored AS (SELECT * FROM gaps WHERE received_score IS NOT NULL), ids AS (SELECT DISTINCT import_id FROM scored),
of_question AS (SELECT s.import_id, s.question_id, avg(received_score) AS mean, count(DISTINCT student_id) AS students FROM scored s GROUP BY 1, 2),
ratios AS (SELECT o.*, q.question_id IS NOT NULL AS known, max_score, mean / CASE WHEN max_score IS NULL OR max_score = 0 THEN 100 ELSE max_score END AS ratio
  FROM of_question o LEFT JOIN questions q ON o.question_id = q.question_id),
quality AS (SELECT import_id, CASE WHEN ratio >= 0.8 THEN 'easy' WHEN ratio <= 0.3 THEN 'hard' ELSE 'normal' END AS label, count(*) AS n FROM ratios GROUP BY 1, 2),
passing AS (SELECT import_id, 'pass' AS label, count(*) FILTER (WHERE received_score >= 60) AS n FROM scored GROUP BY 1
  UNION ALL SELECT import_id, 'fail', count(*) FILTER (WHERE received_score < 60) FROM scored GROUP BY 1),
risks AS (SELECT import_id, CASE WHEN mean < 50 THEN 'systemic' WHEN least < 20 THEN 'spot' ELSE 'ok' END AS label, count(*) AS n
  FROM (SELECT import_id, student_id, avg(received_score) AS mean, min(received_score) AS least FROM scored GROUP BY 1, 2) GROUP BY 1, 2),
judged AS (SELECT import_id, CASE WHEN known AND (students < 5 OR mean < coalesce(max_score, 100) * 0.3 OR mean > coalesce(max_score, 100) * 0.95) THEN 'warning' ELSE 'ok' END AS label, count(*) AS n
  FROM ratios WHERE import_id NOT IN (SELECT import_id FROM validated) GROUP BY 1, 2),
valid AS (SELECT import_id, CASE WHEN status = 'ok' THEN 'ok' ELSE 'warning' END AS label, count(*) AS n FROM validated GROUP BY 1, 2 UNION ALL SELECT * FROM judged),
levels AS (SELECT import_id, alignment_level AS label, count(*) AS n FROM aligned GROUP BY 1, 2
  UNION ALL SELECT import_id, CASE WHEN coalesce(keyword_coverage, 0) >= 0.67 THEN 'high' WHEN coalesce(keyword_coverage, 0) >= 0.33 THEN 'medium' ELSE 'low' END, count(*)
  FROM validated WHERE import_id NOT IN (SELECT import_id FROM aligned) GROUP BY 1, 2),
counted AS (
  SELECT import_id, 'quality' AS chart, label, coalesce(n, 0) AS n FROM (SELECT * FROM ids, (VALUES ('easy'), ('normal'), ('hard')) l(label)) LEFT JOIN quality USING (import_id, label)
  UNION ALL SELECT import_id, 'correlation', label, n FROM passing
  UNION ALL SELECT import_id, 'studentRisk', label, coalesce(n, 0) FROM (SELECT * FROM ids, (VALUES ('ok'), ('systemic'), ('spot')) l(label)) LEFT JOIN risks USING (import_id, label)
  UNION ALL SELECT import_id, 'validation', label, coalesce(n, 0) FROM (SELECT * FROM ids, (VALUES ('ok'), ('warning')) l(label)) LEFT JOIN valid USING (import_id, label)
  UNION ALL SELECT import_id, 'semantic', label, n FROM levels),
shares AS (SELECT import_id, chart, label, {r('100.0::DOUBLE * n / sum(n) OVER (PARTITION BY import_id, chart)', 1)} AS value FROM counted),
told AS (SELECT * FROM answers WHERE language IS NOT NULL),
spoken AS (SELECT import_id, language, {r('avg(final_score)', 2)} AS score, {r('100.0::DOUBLE * count(*) FILTER (WHERE plagiarism_penalty > 0) / count(*)', 2)} AS copied
  FROM told WHERE import_id <> 3 GROUP BY 1, 2
  UNION ALL SELECT 3, language, {r('avg(final_score)', 2)}, {r('100.0::DOUBLE * count(*) FILTER (WHERE plagiarism_penalty > 0) / count(*)', 2)} FROM told GROUP BY 2)
SELECT import_id, chart, 'count' AS series, label, n::DOUBLE AS value FROM counted
UNION ALL SELECT import_id, 'criteria', 'percent', chart || ' ' || label, value FROM shares
  WHERE chart = 'quality' OR (chart = 'correlation' AND label = 'pass') OR (chart = 'studentRisk' AND label = 'ok')
UNION ALL SELECT import_id, 'plagiarism', 'score', upper(language[1]) || language[2:], score FROM spoken
UNION ALL SELECT import_id, 'plagiarism', 'plagiarism', upper(language[1]) || language[2:], copied FROM spoken"""
)
def dashboard_charts(t: Tables):
    """The charts of an import with cached validation, one with cached levels, and one without either or answers."""
    facts = t.facts()
    gap = lambda k, c: F.when(F.col("raw_id") % k != 0, F.col(c)).alias(c)
    rows = facts.select("import_id", gap(29, "question_id"), gap(23, "student_id"), gap(17, "received_score"))
    key = F.col("question_id")
    cached = store.settled(facts.select("import_id", "question_id").distinct())  # stands for caches, which are tables
    status = F.when(key % 3 == 0, "ok").when(key % 3 == 1, "warning").otherwise("error").alias("status")
    validated = cached.where("import_id = 1").select("import_id", status, F.when(key % 10 > 0, key % 10 / 10).alias("keyword_coverage"))
    level = F.when(key % 4 == 0, "low").when(key % 4 == 1, "high").otherwise("medium").alias("alignment_level")
    aligned_ = cached.where("import_id = 2").select("import_id", level)
    answers = t.answers()
    return dashboards.dashboard_charts(rows, t.questions(), validated, aligned_, answers, answers.select("work_id", "import_id").where("import_id <> 3"))
