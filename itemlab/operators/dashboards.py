"""Figures and tallies of dashboards, reports of users and actions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..coefficients import DEFAULT, Coefficients
from ..functions.stats import percent_change, rounded
from . import alignment, criteria, items, paging, students
from .store import settled


def import_figures(facts: DataFrame) -> DataFrame:
    """Each import's figures, of the rows that have a score."""
    return facts.where(F.col("received_score").isNotNull()).groupBy("import_id").agg(
        F.countDistinct("question_id").alias("questions"),
        F.countDistinct("student_id").alias("students"),
        F.count("*").alias("attempts"),
        rounded(F.avg("received_score"), 1).alias("avg_score"),
    )


def overview(facts: DataFrame, digits: int = 1) -> DataFrame:
    """Each import's figures with their change against the import before it, to so many digits; the last row is the current one."""
    before = Window.orderBy("import_id")  # a row for each import
    out = import_figures(facts)
    for name in ("questions", "students", "attempts", "avg_score"):
        change, up = percent_change(F.col(name), F.lag(name).over(before), digits)
        out = out.withColumn(f"{name}_change", change).withColumn(f"{name}_up", up)
    return out


def overview_totals(facts: DataFrame, imports: DataFrame, questions: DataFrame, users: DataFrame) -> DataFrame:
    """One row: imports (``rows_imported``) with rows, estimated megabytes, linked questions, users."""
    one = lambda rows, x: rows.agg(x)
    size = F.greatest(F.lit(0.1), rounded(F.count("*") * 0.0005, 1)).alias("data_processed")
    parts = [
        one(imports, F.count_if(F.col("rows_imported") > 0).alias("total_documents")), one(facts, size),
        one(questions, F.count("syllabus_topic_id").alias("active_questions")), one(users, F.count("*").alias("team_members")),
    ]
    return reduce(DataFrame.crossJoin, parts)  # one row each


def tally(rows: DataFrame, section: str, flag: str) -> DataFrame:
    return rows.groupBy("import_id", F.lit(section).alias("section"), F.col(flag).alias("flag")).agg(F.count("*").alias("n"))


def tallies(sections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Numbers of rows by import, section and flag."""
    return reduce(DataFrame.unionByName, (tally(rows, s, flag) for s, (rows, flag) in sections.items()))


#: Badges of the sections' flags (fixed values); other flags have the badge beside them.
BADGES = {
    "validation": ({"ok": "success", "warning": "warning"}, "danger"), "quality": ({"normal": "success", "too_easy": "warning"}, "danger"),
    "correlation": ({"ok": "success"}, "warning"), "students": ({"ok": "success", "systemic": "danger"}, "warning"),
    "semantic": ({"high": "success", "medium": "warning"}, "danger"), "criteria": ({}, "success"),
}


def section_tables(
    facts: DataFrame, questions: DataFrame, topics: DataFrame, details: DataFrame, criteria_: DataFrame, works: DataFrame, answers: DataFrame,
    semantic: DataFrame | None = None, import_id: int | None = None, c: Coefficients = DEFAULT,
) -> dict[str, DataFrame]:
    """The seven sections' rows, each with ``flag`` and ``badge``; those of items, students and texts have all imports.

    Criteria and answers are of import_id, as far as it has any. The facts are read once, and written with the columns that students and
    correlations need; items' figures and the comparison of texts are made once for all sections.
    """
    facts = settled(facts.select("import_id", "question_id", "student_id", "received_score"))
    own = settled(items.figures(facts, c))
    texts = settled(alignment.linked_texts(questions, settled(topics), semantic, c))
    flagged = {
        "validation": (alignment.validation_of(own, texts, c), "status"),
        "quality": (items.quality_of(own, questions, c), "flag"),
        "correlation": (items.item_total_correlation(facts, c), "flag"),
        "students": (students.student_risk(facts, c), "pattern_type"),
        "semantic": (alignment.alignment_of(own, texts, c), "alignment_level"),
        "criteria": (criteria.criteria_performance(details, criteria_, works, import_id), "performance_level"),
    }
    out = {}
    for section, (rows, column) in flagged.items():
        known, other = BADGES[section]
        badge = reduce(lambda x, kv, column=column: F.when(F.col(column) == kv[0], kv[1]).otherwise(x), known.items(), F.lit(other))
        out[section] = rows.withColumns({"badge": badge, "flag": F.col(column)})
    rate = F.col("plagiarism_rate")
    out["answers"] = criteria.answers_by_language(answers, import_id).withColumns(
        {"badge": F.when(rate > 10, "danger").when(rate > 5, "warning").otherwise("success"), "flag": F.when(rate > 10, "high").otherwise("low")}
    )
    return out


#: What each section's rows are told apart by, and the names it may be sorted by with their columns (fixed values); the last two by all their columns.
SECTION_KEYS = {
    "validation": ["import_id", "question_id"], "quality": ["import_id", "question_id"], "correlation": ["import_id", "question_id"],
    "students": ["import_id", "student_id"], "semantic": ["import_id", "question_id"], "criteria": ["criteria_id"], "answers": ["language"],
}
SECTION_SORTS = {
    "validation": {"question_id": "question_id", "syllabus_title": "title", "avg_score": "avg_score", "attempts": "attempts", "status": "status"},
    "quality": {"question_id": "question_id", "n": "n", "mean_score": "mean_score", "p_correct_proxy": "p_correct", "difficulty_pct": "difficulty_pct", "flag_text": "flag"},
    "correlation": {"question_id": "question_id", "r": "r", "flag": "flag"},
    "students": {c: c for c in ("student_id", "avg_item", "min_item", "discipline_total", "pattern_type", "notes")},
    "semantic": {"question_id": "question_id", "syllabus_title": "title", "discipline_name": "discipline_name", "average_score": "average_score", "alignment_level": "alignment_level"},
}


def section_page(
    rows: DataFrame, section: str, sort: str | None = None, descending: bool = False, badge: str = "all", number: int = 1, size: int = paging.PAGE
) -> tuple[DataFrame, int, int]:
    """A page of a section's rows (of ``section_tables``) with ``position``, the number of all rows, and of pages.

    Rows of one badge, or all; sorted by a name that the section allows, otherwise by its keys, which also settle ties.
    """
    sorts = SECTION_SORTS.get(section, {c: c for c in rows.columns})
    rows = settled(paging.with_badge(rows, ["badge"], badge))  # counted and cut
    column = sorts.get(sort) if sort else None
    order = ([F.desc(column) if descending else F.asc(column)] if column else []) + [F.asc(k) for k in SECTION_KEYS[section]]
    cut, total, pages = paging.page(rows.orderBy(*order), number, size)
    before = (min(max(1, number), pages) - 1) * size
    return cut.withColumn("position", F.row_number().over(Window.orderBy(*order)) + before), total, pages  # a page of rows


def section_tallies(sections: dict[str, DataFrame]) -> DataFrame:
    """Numbers of rows by section, flag and badge."""
    parts = (rows.groupBy(F.lit(name).alias("section"), "flag", "badge").agg(F.count("*").alias("n")) for name, rows in sections.items())
    return reduce(DataFrame.unionByName, parts)


def pass_fail(facts: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    rows = facts.where(F.col("received_score").isNotNull())
    passed = F.count_if(F.col("received_score") >= c.pass_mark)
    return rows.groupBy("import_id").agg(
        passed.alias("passed"), (F.count("*") - passed).alias("failed"), rounded(100 * passed / F.count("*"), 1).alias("passed_pct")
    )


#: Facts that a task groups, about: what it holds doesn't grow with the input, nor with the size of files' splits or the shuffle's partitions.
FACTS_A_TASK = 100_000


def _facts_by(facts: DataFrame, a_task: int = FACTS_A_TASK) -> DataFrame:
    """``import_id, level, question_id, student_id, mean, least, students, n, passed``: of questions, students and imports, in one scan of the facts.

    level is 1 for a question's row, 2 for a student's, 3 for an import's.
    """
    cell = ["import_id", "question_id", "student_id"]
    rows = settled(facts.where(F.col("received_score").isNotNull()).select(*cell, "received_score"))
    # most cells are a row, so nothing is gained by adding up before they are dealt out
    rows = rows.repartition(rows.count() // a_task + 1, *cell)
    passed = F.count_if(F.col("received_score") >= DEFAULT.pass_mark).alias("passed")
    cells = rows.groupBy(*cell).agg(F.sum("received_score").alias("total"), F.min("received_score").alias("least"), F.count("*").alias("n"), passed)
    levels = cells.groupingSets([["import_id", "question_id"], ["import_id", "student_id"], ["import_id"]], *cell)
    return levels.agg(
        F.grouping_id(*cell).alias("level"), (F.sum("total") / F.sum("n")).alias("mean"),
        F.min("least").alias("least"), F.count("student_id").alias("students"), F.sum("n").alias("n"), F.sum("passed").alias("passed"),
    )


def dashboard_charts(
    facts: DataFrame, questions: DataFrame, validated: DataFrame, aligned: DataFrame, answers: DataFrame, works: DataFrame, c: Coefficients = DEFAULT
) -> DataFrame:
    """``import_id, chart, series, label, value``: the charts of each import with scores.

    * ``quality``: questions that are easy, normal and hard; ``correlation``: attempts that pass and fail; ``studentRisk``:
      students by their mean and lowest score; ``criteria``: shares of these in percent.
    * ``validation``: by the cached status (validated: ``import_id, status, keyword_coverage``); where an import has
      none cached, questions with few students or a mean near an end of their scale count as warnings.
    * ``semantic``: by the cached level (aligned: ``import_id, alignment_level``), or else by bands of the cached coverage.
    * ``plagiarism``: mean score and share of penalties by language, of the import's answers (by works) or, without any, of all.
    """
    by = settled(_facts_by(facts))
    scale = questions.select("question_id", "max_score", F.lit(True).alias("known"))
    of_questions = by.where("level = 1").join(scale, "question_id", "left")
    top = F.when(F.col("max_score") != 0, F.col("max_score")).otherwise(c.default_maximum)
    ratio = F.when(top > 0, F.col("mean") / top).otherwise(0.0)
    kind = F.when(ratio >= c.easy, "easy").when(ratio <= c.hard, "hard").otherwise("normal")
    limit = F.coalesce("max_score", F.lit(c.default_maximum))
    doubtful = F.col("known") & ((F.col("students") < c.validation_attempts) | (F.col("mean") < limit * c.validation_low) | (F.col("mean") > limit * c.validation_high))
    tally = lambda rows, label: rows.groupBy("import_id", label.alias("label")).agg(F.count("*").alias("n"))
    quality = tally(of_questions, kind)
    risk = F.when(F.col("mean") < c.systemic_average, "systemic").when(F.col("least") < c.spot_minimum, "spot").otherwise("ok")
    students_ = tally(by.where("level = 2"), risk)
    totals = by.where("level = 3")
    passing = totals.select("import_id", F.inline(F.array(F.struct(F.lit("pass").alias("label"), F.col("passed").alias("n")), F.struct(F.lit("fail").alias("label"), (F.col("n") - F.col("passed")).alias("n")))))

    cached = tally(validated, F.when(F.col("status") == "ok", "ok").otherwise("warning"))
    judged = tally(of_questions, F.when(F.coalesce(doubtful, F.lit(False)), "warning").otherwise("ok"))
    validation_ = cached.unionByName(judged.join(cached.select("import_id").distinct(), "import_id", "left_anti"))
    levels = tally(aligned, F.col("alignment_level"))
    cover = F.coalesce("keyword_coverage", F.lit(0.0))
    bands = tally(validated, F.when(cover >= c.coverage_high, "high").when(cover >= c.coverage_medium, "medium").otherwise("low"))
    semantic = levels.unionByName(bands.join(levels.select("import_id").distinct(), "import_id", "left_anti"))

    everyone = totals.select("import_id")
    full = lambda rows, labels: everyone.select("import_id", F.explode(F.array(*(F.lit(x) for x in labels))).alias("label")).join(rows, ["import_id", "label"], "left").fillna(0, ["n"])
    parts = {"quality": full(quality, ["easy", "normal", "hard"]), "correlation": passing, "studentRisk": full(students_, ["ok", "systemic", "spot"]), "validation": full(validation_, ["ok", "warning"])}
    shares = {"quality": None, "correlation": "pass", "studentRisk": "ok"}
    whole = Window.partitionBy("import_id")  # a few labels each
    share = F.coalesce(rounded(100 * F.col("n") / F.nullif(F.sum("n").over(whole), F.lit(0)), 1), F.lit(0.0)).alias("value")
    of = []
    for name, only in shares.items():
        rows = parts[name].select("import_id", "label", share)
        rows = rows.where(F.col("label") == only) if only else rows
        of.append(rows.select("import_id", F.lit("criteria").alias("chart"), F.lit("percent").alias("series"), F.concat(F.lit(f"{name} "), "label").alias("label"), "value"))
    counts = [rows.select("import_id", F.lit(name).alias("chart"), F.lit("count").alias("series"), "label", F.col("n").cast("double").alias("value")) for name, rows in {**parts, "semantic": semantic.join(everyone, "import_id", "left_semi").where(F.col("label").isin("high", "medium", "low"))}.items()]

    told = answers.where(F.col("language").isNotNull())
    figures = [F.count("*").alias("n"), rounded(F.avg("final_score"), 2).alias("score"), rounded(100 * F.count_if(F.col("plagiarism_penalty") > 0) / F.count("*"), 2).alias("plagiarism")]
    own = told.drop("import_id").join(works.select("work_id", "import_id"), "work_id").groupBy("import_id", "language").agg(*figures)
    without = everyone.join(own.select("import_id").distinct(), "import_id", "left_anti")
    languages = own.join(everyone, "import_id", "left_semi").unionByName(without.crossJoin(told.groupBy("language").agg(*figures)))  # a row for each import and language
    label = F.concat(F.upper(F.substring("language", 1, 1)), F.expr("substring(language, 2)"))
    both = F.inline(F.array(F.struct(F.lit("score").alias("series"), F.col("score").alias("value")), F.struct(F.lit("plagiarism").alias("series"), F.col("plagiarism").alias("value"))))
    spoken = languages.select("import_id", label.alias("label"), both).select("import_id", F.lit("plagiarism").alias("chart"), "series", "label", "value")
    return reduce(DataFrame.unionByName, [*counts, *of, spoken])


#: Texts that stand for a question's missing one.
PLACEHOLDER = r"(?i)^\s*(question|вопрос)\s+[0-9]+\s*$"


def link_list(facts: DataFrame, questions: DataFrame, topics: DataFrame, placeholder: str = PLACEHOLDER, by_import: bool = True) -> DataFrame:
    """Questions with real text of each import, or of all together, with discipline and topic if linked."""
    own = facts.groupBy(*(["import_id"] if by_import else []), "question_id").agg(F.max("discipline_name").alias("discipline"))
    text = F.col("question_text")
    real = questions.where(text.isNotNull() & (F.trim(text) != "") & ~text.rlike(placeholder))
    rows = own.join(real, "question_id").join(topics.select("syllabus_topic_id", "title"), "syllabus_topic_id", "left")
    columns = [c for c in ("import_id", "question_id", "question_text", "discipline", "title") if c in rows.columns]
    return rows.select(*columns, F.col("title").isNotNull().alias("is_linked"))


def link_counts(links: DataFrame) -> DataFrame:
    """Of each import: questions, linked and unlinked ones."""
    return links.groupBy("import_id").agg(
        F.count("*").alias("questions"), F.count_if("is_linked").alias("linked"), F.count_if(~F.col("is_linked")).alias("unlinked")
    )


def filtered(rows: DataFrame, text: str = "", columns: list[str] | None = None, **equal) -> DataFrame:
    """Rows one of whose columns contains the text, whatever its case, and that have these values; "all" is any."""
    if text:
        rows = rows.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c).cast("string")), F.lower(F.lit(text))) for c in columns or rows.columns)))
    for name, value in equal.items():
        if value != "all":
            rows = rows.where(F.col(name) == value)
    return rows


def by_severity(rows: DataFrame, flag: str = "flag") -> DataFrame:
    """Too hard before too easy before the others."""
    rank = F.when(F.col(flag) == "too_hard", 3).when(F.col(flag) == "too_easy", 2).otherwise(1)
    return rows.orderBy(F.desc(rank), "import_id", "question_id")


def previous_imports(imports: DataFrame) -> DataFrame:
    """``import_id, previous_id``: the last import created before each one."""
    before = Window.orderBy("created_at", "import_id")  # a row for each import
    return imports.select("import_id", F.lag("import_id").over(before).alias("previous_id"))


def audit_report(logs: DataFrame, users: DataFrame, n: int = 100) -> DataFrame:
    """The newest n actions with their users; those of removed users, too."""
    rows = logs.join(users, "user_id", "left").orderBy(F.desc("created_at"), F.desc("log_id")).limit(n)
    return rows.select("log_id", "user_id", "user_name", "action_type", "created_at")


def audit_totals(logs: DataFrame, as_of) -> DataFrame:
    today = F.to_date("created_at") == F.to_date(F.lit(as_of))
    return logs.groupBy("action_type").agg(F.count("*").alias("total"), F.count_if(today).alias("today"))


def user_report(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with their roles, the newest first."""
    return users.join(roles, "role_id", "left").orderBy(F.desc("user_id")).select("user_id", "user_name", "role_name", "is_active")


def user_totals(report: DataFrame, superadmin: str = "superadmin") -> DataFrame:
    """One row: users, active ones, and those with the highest role."""
    return report.agg(
        F.count("*").alias("total"), F.count_if("is_active").alias("active"), F.count_if(F.col("role_name") == superadmin).alias("superadmins")
    )


def import_statistics(facts: DataFrame, topics: DataFrame, imports: DataFrame) -> DataFrame:
    """One row: rows, distinct questions, students and disciplines, topics with and without an upload, imports."""
    rows = facts.agg(
        F.count("*").alias("rows"), F.countDistinct("question_id").alias("questions"), F.countDistinct("student_id").alias("students"),
        F.countDistinct("discipline_name").alias("disciplines"),
    )
    topic = topics.agg(F.count("*").alias("topics"), F.countDistinct("discipline_name").alias("topic_disciplines"))
    return reduce(DataFrame.crossJoin, [rows, topic, imports.agg(F.count("*").alias("imports"))])  # one row each


def topic_list(topics: DataFrame, uploaded: DataFrame | None = None, n: int = 100) -> DataFrame:
    """Topics by id; with uploaded (``discipline_name``) the first n of those whose discipline has a syllabus."""
    if uploaded is None:
        return topics.orderBy("syllabus_topic_id")
    return topics.join(uploaded.select("discipline_name").distinct(), "discipline_name", "left_semi").orderBy("syllabus_topic_id").limit(n)


def latest_import(imports: DataFrame, filename: str) -> DataFrame:
    return imports.where(F.col("source_filename") == filename).orderBy(F.desc("import_id")).limit(1)


def question_list(questions: DataFrame, disciplines: DataFrame, metrics: DataFrame) -> DataFrame:
    return questions.join(disciplines, "discipline_id", "left").join(metrics, "question_id", "left")


def disciplines(facts: DataFrame) -> DataFrame:
    rows = facts.where(F.col("discipline_name").isNotNull() & (F.col("discipline_name") != ""))
    return rows.select("import_id", "discipline_name").distinct()
