"""Imported rows, all strings, to typed tables with counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.files import read_delimited, read_spreadsheet
from .commits import Commit, Store
from .ranks import numbered
from .store import upsert

#: Header names of the columns of exam results, in order of preference (fixed values).
ALIASES = {
    "question_id": ["ID вопроса", "ID тематики", "ID fråga", "question_id"],
    "student_id": ["ID студента", "ID student", "student_id"],
    "course": ["Курс", "Kurs", "course_number"],
    "score_after": ["Оценка после апелляции", "Bedömning efter överklagande", "score_after_appeal"],
    "score_before": ["Оценка до апелляции", "Bedömning före överklagande", "score_before_appeal"],
    "score_discipline": ["Оценка за дисциплину", "Bedömning för disciplin", "discipline_score"],
    "discipline": ["Дисциплина", "Disciplin", "discipline_name"],
}


def resolve(columns: list[str], aliases: list[str]) -> str | None:
    """The column of the first alias that there is, exactly or else without case, blanks and byte order mark."""
    for a in aliases:
        if a in columns:
            return a
    plain = {c.replace("﻿", "").strip().lower(): c for c in reversed(columns)}
    return next((plain[a.strip().lower()] for a in aliases if a.strip().lower() in plain), None)


def named(rows: DataFrame, aliases: dict[str, list[str]] = ALIASES, also: list[str] | None = None) -> DataFrame:
    """The columns of aliases by their names there, null where there is none, and those of also."""
    found = {name: resolve(rows.columns, names) for name, names in aliases.items()}
    columns = ((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(name) for name, c in found.items())
    return rows.select(*columns, *(also or []))


def number(text: Column) -> Column:
    """Decimal comma or point; null if it isn't a number."""
    plain = F.trim(F.replace(text, F.lit(","), F.lit(".")))
    return F.when(plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def whole(text: Column) -> Column:
    """A number cut to its whole part."""
    x = number(text)
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


def given(text: Column) -> Column:
    """Null for empty cells and dashes."""
    plain = F.trim(text)
    return F.when((plain != "") & (plain != "-"), plain)


def exam_results(rows: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Typed rows of ``question_id, student_id, course_number, received_score, discipline_name``, with the columns of also.

    The score is the first given of after appeal, before appeal and discipline. A missing course is
    null, a missing discipline empty. A row is kept if it has a question or a student.
    """
    score = number(F.coalesce(given(F.col("score_after")), given(F.col("score_before")), given(F.col("score_discipline"))))
    out = rows.select(
        whole(F.col("question_id")).alias("question_id"), whole(F.col("student_id")).alias("student_id"),
        whole(F.col("course")).cast("int").alias("course_number"), score.alias("received_score"),
        F.coalesce(F.trim("discipline"), F.lit("")).alias("discipline_name"), *(also or []),
    )
    return out.withColumn("is_kept", F.col("question_id").isNotNull() | F.col("student_id").isNotNull())


#: The tables that an import of exam results changes.
EXAM_TABLES = {
    "results": "import_id long, student_id long, question_id long, discipline_name string, course_number int, received_score double, "
    "score_after_appeal double, score_before_appeal double, discipline_score double, seq long",
    "questions": "question_id long, question_text string, max_score double, question_type string",
    "hier_questions": "question_id long, question_text string, max_score double, question_type string",
    "students": "student_id long, course_number int",
    "works": "work_id string, student_id long, question_id long, discipline_name string, course_number int, import_id long",
    "topics": "discipline_name string, course_number int, topic_code string, title string, keywords string",
    "log": "import_id long, source_filename string, source_format string, rows_total long, rows_imported long, rows_rejected long, import_type string",
}
#: Keys of those of which a row is only added where there is none.
EXAM_KEYS = {
    "questions": ["question_id"], "hier_questions": ["question_id"], "students": ["student_id"],
    "works": ["student_id", "question_id"], "topics": ["discipline_name", "course_number", "topic_code"],
}


def result_rows(typed: DataFrame, import_id: int) -> DataFrame:
    """The kept rows as results: the one score in all four columns of scores."""
    score = F.col("received_score")
    columns = {"import_id": F.lit(import_id).cast("long"), "score_after_appeal": score, "score_before_appeal": score, "discipline_score": score}
    return typed.where("is_kept").drop("is_kept").withColumns(columns)


def exam_tables(results: DataFrame, default_course: int = 3, default_maximum: float = 100.0) -> dict[str, DataFrame]:
    """What the results of an import add to its other tables: candidates with seq, of which the first of each key counts.

    Of rows of one seq it is the first by its other columns, so that a commit done again is the same.

    A zero id is none, as is an empty one; so is a discipline named 0.
    """
    real = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    course = F.coalesce("course_number", F.lit(default_course)).alias("course_number")
    blank = lambda kind: [F.lit("").alias("question_text"), F.lit(default_maximum).alias("max_score"), F.lit(kind).alias("question_type"), "seq"]
    asked = results.where(real("question_id"))
    work = F.concat_ws("_", "student_id", "question_id").alias("work_id")
    return {
        "questions": asked.select("question_id", *blank("single")),
        "hier_questions": asked.select("question_id", *blank("single_choice")),
        "students": results.where(real("student_id")).select("student_id", course, "seq"),
        "works": asked.where(real("student_id")).select(work, "student_id", "question_id", "discipline_name", course, "import_id", "seq"),
        "topics": auto_topics(results, default_course),
    }


def import_exam(tables: Store, rows: DataFrame, filename: str, source_format: str, aliases: dict[str, list[str]] = ALIASES, order: str | None = None) -> int:
    """Imports the rows of a file of exam results into all its tables and the log, in one commit; the import's id.

    Either all tables have the import or none. The file is read once: counters are observed beside
    the write of the results, and the other tables are made of what was written. order is the column of the rows' order in the file,
    their order as they are read if None. Without a single row to keep it is an error and nothing changes.
    """
    commit = tables.commit()
    seq = (F.col(order).cast("long") if order else F.monotonically_increasing_id()).alias("seq")
    typed = exam_results(named(rows.withColumn("seq", seq), aliases, ["seq"]), ["seq"])
    seen = Observation()
    watched = typed.observe(seen, F.count("*").alias("total"), F.count_if("is_kept").alias("kept"))
    results = commit.append("results", result_rows(watched, commit.number))
    counts = seen.get
    if not counts["kept"]:
        raise ValueError("no row of the file has a question or a student; are its columns named otherwise?")
    for name, new in exam_tables(results).items():
        commit.insert_ignore(name, new, EXAM_KEYS[name], ["seq", *(c for c in new.columns if c != "seq" and c not in EXAM_KEYS[name])])
    log = (commit.number, filename, source_format, counts["total"], counts["kept"], counts["total"] - counts["kept"], "exam_results_upload")
    commit.append("log", results.sparkSession.createDataFrame([log], EXAM_TABLES["log"]))
    commit.prepare()
    commit.publish()
    return commit.number


def import_exam_file(tables: Store, path: str) -> int:
    """Imports a file of exam results by its extension: csv, xlsx or ods."""
    kind = path.rpartition(".")[2].lower()
    if kind not in ("csv", "xlsx", "ods"):
        raise ValueError(f"files of exam results are csv, xlsx or ods, not {kind}")
    spark = tables.spark
    rows = read_delimited(spark, path) if kind == "csv" else read_spreadsheet(spark, path)
    return import_exam(tables, rows, path.rpartition("/")[2], kind, order=None if kind == "csv" else "row")


def import_counts(typed: DataFrame) -> DataFrame:
    return typed.agg(
        F.count("*").alias("rows_total"), F.count_if("is_kept").alias("rows_imported"), F.count_if(~F.col("is_kept")).alias("rows_rejected"),
        F.countDistinct(F.when(F.col("is_kept"), F.col("question_id"))).alias("questions"),
        F.countDistinct(F.when(F.col("is_kept"), F.col("student_id"))).alias("students"),
    )


def auto_topics(results: DataFrame, course: int = 3) -> DataFrame:
    """A topic for each discipline, its code made of the name, its keywords the name in lower case."""
    names = results.where("discipline_name NOT IN ('', '0')").groupBy("discipline_name").agg(F.min("seq").alias("seq"))
    code = F.concat(F.lit("AUTO_"), F.md5("discipline_name"))
    return names.select(
        "discipline_name", F.lit(course).alias("course_number"), code.alias("topic_code"),
        F.col("discipline_name").alias("title"), F.lower("discipline_name").alias("keywords"), "seq",
    )


def weight(text: Column) -> Column:
    """A number at the beginning, without percent sign and blanks."""
    plain = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[%\s]", "")
    return F.nullif(F.regexp_extract(plain, r"^[-+]?[0-9.]+", 0), F.lit("")).try_cast("double")


def criteria(rows: DataFrame) -> DataFrame:
    """``criteria_id, kazakh, russian, english, weight``: kept with an id, a name and a positive weight.

    Missing Russian and English names are the Kazakh one.
    """
    name = lambda c: F.coalesce(given(F.col(c)), given(F.col("kazakh")))
    out = rows.select(
        whole(F.col("criteria_id")).alias("criteria_id"), given(F.col("kazakh")).alias("name_kazakh"),
        name("russian").alias("name_russian"), name("english").alias("name_english"), weight(F.col("weight")).alias("weight_percent"),
    )
    good = F.col("criteria_id").isNotNull() & F.col("name_kazakh").isNotNull() & (F.col("weight_percent") > 0)
    return out.withColumn("is_kept", F.coalesce(good, F.lit(False)))


#: Header names of the columns of criteria, in order of preference (fixed values).
CRITERIA = {
    "criteria_id": ["ID критерия"],
    "kazakh": ["Наименование критерия на казахском"],
    "russian": ["Наименование критерия на русском"],
    "english": ["Наименование критерия на английском"],
    "weight": ["Доля от оценки (в %)", "Доля"],
}


def criteria_columns(rows: DataFrame) -> DataFrame:
    """The columns of criteria by their names, or by position where neither the Russian nor the English name is a header.

    By position the weight is the fifth column, in a table of fewer the third.
    """
    columns = rows.columns
    if any(name in columns for kind in ("russian", "english") for name in CRITERIA[kind]):
        found = {kind: next((n for n in names if n in columns), None) for kind, names in CRITERIA.items()}
    else:
        at = {kind: k for k, kind in enumerate(CRITERIA)} | {"weight": 4 if len(columns) > 4 else 2}
        found = {kind: columns[k] if k < len(columns) else None for kind, k in at.items()}
    return rows.select(*((F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(kind) for kind, c in found.items()))


def upserted(existing: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """existing with the inserted rows of new (those with outcome inserted), the last of each key by seq."""
    return upsert(existing, new.where("outcome = 'inserted'").drop("outcome"), key, seq)


def missing_works(answers: DataFrame, works: DataFrame) -> DataFrame:
    """Work rows for the inserted answers of unknown works: the student is the id's leading number, the question 0."""
    new = answers.where("outcome = 'inserted'").select("work_id").distinct().join(works.select("work_id"), "work_id", "left_anti")
    student = F.coalesce(F.regexp_extract("work_id", r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0))
    return new.select("work_id", student.alias("student_id"), F.lit(0).cast("long").alias("question_id"))


def score_cascade(before: Column, after: Column, discipline: Column) -> Column:
    """The first that is a number of the score before appeal, after it, and of the discipline."""
    return F.coalesce(number(before), number(after), number(discipline))


def evaluation_details(rows: DataFrame, known: DataFrame, also: list[str] | None = None) -> DataFrame:
    """``work_id, criteria_id, score`` typed, with outcome inserted, invalid (unknown criterion) or skipped."""
    typed = rows.select(
        given(F.col("work_id")).alias("work_id"), whole(F.col("criteria_id")).alias("criteria_id"),
        F.coalesce(number(F.col("score")), F.lit(0.0)).alias("score"), *(also or []),
    )
    typed = typed.join(known.select("criteria_id").distinct().withColumn("__known", F.lit(True)), "criteria_id", "left")
    skipped = F.col("work_id").isNull() | F.col("criteria_id").isNull() | (F.col("score") < 0) | (F.col("score") > 100)
    outcome = F.when(skipped, "skipped").when(F.col("__known").isNull(), "invalid").otherwise("inserted")
    return typed.withColumn("outcome", outcome).drop("__known")


def student_answers(rows: DataFrame, also: list[str] | None = None) -> DataFrame:
    """``work_id, language, question, answer, score, comment, penalty`` with the answer decoded from base64."""
    raw = F.try_to_binary(F.trim("answer"), F.lit("base64"))
    missing = F.lit(False)
    for c in ("work_id", "language", "question", "answer"):
        missing = missing | given(F.col(c)).isNull()
    outcome = F.when(missing, "invalid").when(raw.isNull(), "decode_error").otherwise("inserted")
    return rows.select(
        "work_id", "language", F.col("question").alias("question_text"), F.try_validate_utf8(raw.cast("string")).alias("answer_text"),
        number(F.col("score")).alias("final_score"), F.col("comment").alias("teacher_comment"),
        F.coalesce(number(F.col("penalty")), F.lit(0.0)).alias("plagiarism_penalty"), outcome.alias("outcome"), *(also or []),
    )


#: Characters of a question that tell answers apart.
QUESTION_KEY = 191
#: The tables that imports of evaluations and answers change.
EVALUATION_TABLES = {
    "evaluations": "work_id string, criteria_id long, score double",
    "answers": "work_id string, language string, question_key string, question_text string, answer_text string, final_score double, teacher_comment string, plagiarism_penalty double",
    "works": "work_id string, student_id long, question_id long",
    "log": EXAM_TABLES["log"],
}


def counted(rows: DataFrame, outcomes: list[str]) -> tuple[DataFrame, Observation]:
    """The rows, and how many of them have each outcome: observed as they are written, without a pass of its own."""
    seen = Observation()
    counts = (F.count_if(F.col("outcome") == name).alias(name) for name in outcomes)
    return rows.observe(seen, F.count("*").alias("total"), *counts), seen


def _logged(commit: Commit, counts: dict[str, int], filename: str, kind: str) -> dict[str, int]:
    """Publishes the commit with its row in the log; the counters."""
    row = (commit.number, filename, filename.rpartition(".")[2], counts["total"], counts["inserted"], counts["total"] - counts["inserted"], kind)
    commit.append("log", commit.store.spark.createDataFrame([row], EXAM_TABLES["log"]))
    commit.prepare()
    commit.publish()
    return counts


def import_evaluations(tables: Store, rows: DataFrame, criteria: DataFrame, filename: str, order: str) -> dict[str, int]:
    """Puts the scores of works by criteria in the place of earlier ones; how many rows were inserted, invalid or skipped.

    rows have ``work_id, criteria_id, score`` as strings and order; of several for a work and criterion the last counts.
    """
    commit = tables.commit()
    watched, seen = counted(evaluation_details(rows, criteria, [order]), ["inserted", "invalid", "skipped"])
    commit.upsert("evaluations", watched.where("outcome = 'inserted'"), ["work_id", "criteria_id"], order)
    return _logged(commit, seen.get, filename, "evaluation_details_upload")


def import_answers(tables: Store, rows: DataFrame, filename: str, order: str) -> dict[str, int]:
    """Puts answers in the place of earlier ones to the same question in the same language, and adds the works they name that are unknown.

    Questions are the same if their first QUESTION_KEY characters are. How many rows were inserted, invalid, or couldn't be decoded.
    """
    commit = tables.commit()
    watched, seen = counted(student_answers(rows, [order]), ["inserted", "invalid", "decode_error"])
    new = watched.where("outcome = 'inserted'").withColumn("question_key", F.substring("question_text", 1, QUESTION_KEY))
    put = commit.upsert("answers", new, ["work_id", "language", "question_key"], order)
    works = missing_works(put.withColumn("outcome", F.lit("inserted")), tables.read("works", commit.base))
    commit.insert_ignore("works", works, ["work_id"], ["work_id"])
    return _logged(commit, seen.get, filename, "student_answers_upload")


def by_position(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str], within: list[str]) -> DataFrame:
    """The n-th row of left with the n-th of right in each group; what is left over has no partner and goes."""
    return numbered(left, within, left_order).join(numbered(right, within, right_order), [*within, "position"])
