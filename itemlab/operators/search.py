"""Search: by id with a prefix, by vector, by words; and the index behind it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..functions.vectors import nearest

#: Letters and words before a number that name an entity (fixed values).
PREFIXES = {
    "question": ("q", "question", "вопрос"), "topic": ("t", "topic", "тема"), "discipline": ("d", "discipline", "дисциплина"),
    "import": ("i", "import", "импорт"), "student": ("s", "student", "студент"), "exam": ("e", "exam", "экзамен"),
    "rule": ("r", "rule", "правило"), "criteria": ("c", "criteria", "критерий"), "answer": ("a", "answer", "ответ"),
}
_OF = {word: kind for kind, words in PREFIXES.items() for word in words}
_QUERY = re.compile(rf"^\s*({'|'.join(sorted(_OF, key=len, reverse=True))})\s*[:#]?\s*(\d+)\s*$", re.IGNORECASE)


def parse_query(text: str) -> tuple[str | None, int | None]:
    """The entity and number of a query such as ``q12``, ``topic: 3`` or ``12``; None where it names none."""
    if m := _QUERY.match(text):
        return _OF[m[1].lower()], int(m[2])
    return None, int(text) if text.strip().isdigit() else None


def clamp_k(k: int) -> int:
    return min(30, max(1, k))


def _entity(rows: DataFrame, kind: str, key: str, content: str, *meta: str) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("entity_type"),
        F.col(key).cast("long").alias("entity_id"),
        F.substring(F.col(content).cast("string"), 1, 200).alias("content"),
        F.to_json(F.struct(*meta), {"ignoreNullFields": "false"}).alias("meta") if meta else F.lit("{}").alias("meta"),
    )


def entity_sources(
    facts: DataFrame, questions: DataFrame, topics: DataFrame, imports: DataFrame, rules: DataFrame, criteria: DataFrame,
    answers: DataFrame, validation: DataFrame | None = None, alignment: DataFrame | None = None,
) -> dict[str, tuple]:
    """For by_id: what each kind of entity is found by and shown with.

    All are lazy; a filter on a key reaches the tables through the joins and groups. validation and
    alignment (``question_id`` with ``status`` and ``alignment_level``) are of any import.
    """
    scored = facts.where(F.col("received_score").isNotNull())
    score = F.col("received_score")
    topic = topics.select("syllabus_topic_id", F.col("discipline_name").alias("discipline"), F.col("title").alias("topic"))
    question = questions.join(topic, "syllabus_topic_id", "left")
    for rows, own, name in ((validation, "status", "validation_status"), (alignment, "alignment_level", "alignment_level")):
        if rows is None:
            question = question.withColumn(name, F.lit(None).cast("string"))
        else:
            question = question.join(rows.groupBy("question_id").agg(F.min(own).alias(name)), "question_id", "left")
    figures = scored.groupBy("question_id").agg(rounded(F.avg(score), 1).alias("avg_score"), F.count("*").alias("attempts"))
    question = question.join(figures, "question_id", "left").fillna(0, ["attempts"])
    student = scored.groupBy("student_id").agg(
        rounded(F.avg(score), 2).alias("avg"), F.min(score).alias("min"), F.max(score).alias("max"), F.count("*").alias("n_items")
    )
    exam = facts.groupBy("exam_id").agg(F.countDistinct("student_id").alias("students"), F.count("*").alias("attempts"))
    label = lambda rows, word, key: rows.withColumn("label", F.concat(F.lit(f"{word} #"), F.col(key).cast("string")))
    return {
        "question": (question, "question_id", "question_text", "discipline", "topic", "validation_status", "alignment_level", "avg_score", "attempts"),
        "topic": (topics.withColumn("discipline", F.col("discipline_name")), "syllabus_topic_id", "title", "discipline"),
        "student": (label(student, "Студент", "student_id"), "student_id", "label", "avg", "min", "max", "n_items"),
        "import": (imports.select("*", F.col("import_type").alias("type"), F.col("rows_imported").alias("rows")), "import_id", "source_filename", "type", "rows"),
        "exam": (label(exam, "Экзамен", "exam_id"), "exam_id", "label", "students", "attempts"),
        "rule": (rules.withColumn("active", F.col("is_active")), "rule_id", "rule_name", "active"),
        "criteria": (criteria.withColumn("weight", F.col("weight_percent")), "criteria_id", "name", "weight"),
        "answer": (
            answers.select("*", F.col("language").alias("lang"), F.col("final_score").alias("score"), F.col("plagiarism_penalty").alias("penalty")),
            "answer_id", "answer_text", "work_id", "lang", "score", "penalty",
        ),
    }


def word_sources(
    questions: DataFrame, topics: DataFrame, imports: DataFrame, rules: DataFrame, criteria: DataFrame, answers: DataFrame
) -> dict[str, tuple]:
    """For by_words: the kinds of entity in order, their keys, and the columns that are searched."""
    names = topics.where(F.col("discipline_name").isNotNull()).select("discipline_name").distinct()
    names = names.withColumn("discipline_id", F.crc32(F.col("discipline_name").cast("binary")))
    return {
        "question": (questions, "question_id", ["question_text"]), "topic": (topics, "syllabus_topic_id", ["title", "keywords"]),
        "discipline": (names, "discipline_id", ["discipline_name"]), "import": (imports, "import_id", ["source_filename", "import_type"]),
        "rule": (rules, "rule_id", ["rule_name"]), "criteria": (criteria, "criteria_id", ["name"]),
        "answer": (answers, "answer_id", ["answer_text", "work_id"]),
    }


def by_id(sources: dict[str, tuple], number: int, kind: str | None = None) -> DataFrame:
    """The entities of a number, in all sources or one; sources: kind to rows, key, content column and columns of meta."""
    chosen = {k: v for k, v in sources.items() if kind is None or k == kind}
    parts = [_entity(rows.where(F.col(key) == number), k, key, content, *meta) for k, (rows, key, content, *meta) in chosen.items()]
    if not parts:
        any_rows, key, content, *_ = next(iter(sources.values()))
        return _entity(any_rows.limit(0), kind or "", key, content)
    return reduce(DataFrame.unionByName, parts)


def by_words(sources: dict[str, tuple[DataFrame, str, list[str]]], text: str, k: int = 10) -> DataFrame:
    """Up to k rows of each source one of whose columns contains the text, and k in all, by order of sources and keys."""
    k = clamp_k(k)
    parts = []
    for order, (kind, (rows, key, columns)) in enumerate(sources.items()):
        hit = reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c)), F.lower(F.lit(text))) for c in columns))
        part = _entity(rows.where(hit), kind, key, columns[0]).withColumn("source_order", F.lit(order))
        parts.append(part.orderBy("entity_id").limit(k))
    return reduce(DataFrame.unionByName, parts).orderBy("source_order", "entity_id").limit(k).drop("source_order")


def by_vector(index: DataFrame, query: list[float], k: int = 10, kind: str | None = None) -> DataFrame:
    """The k entities of ``entity_type, entity_id, content, embedding`` nearest to the query."""
    rows = index if kind is None else index.where(F.col("entity_type") == kind)
    rows = rows.withColumnsRenamed({"entity_id": "id", "embedding": "vector"})
    return nearest(rows, query, clamp_k(k)).select("entity_type", F.col("id").alias("entity_id"), "content", "similarity")


def search(text: str, ids: dict, words: dict, index: DataFrame | None = None, query: list[float] | None = None, k: int = 10) -> DataFrame:
    """By id if the text names one that exists, else by vector if there is one, else by words; an empty text finds nothing."""
    kind, number = parse_query(text)
    if number is not None and (kind is None or kind in ids):
        found = by_id(ids, number, kind)
        if kind is not None or not found.isEmpty():
            return found
    elif kind is not None or not text.strip():
        return by_id(ids, -1)
    if index is not None and query is not None:
        return by_vector(index, query, k)
    return by_words(words, text, k)


def index_entries(questions: DataFrame, topics: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Texts to be embedded: questions and topics; with existing keys only those that aren't indexed yet."""
    q = questions.select(F.lit("question").alias("entity_type"), F.col("question_id").cast("long").alias("entity_id"), F.col("question_text").alias("t"))
    t = topics.select(F.lit("topic"), F.col("syllabus_topic_id").cast("long"), F.concat_ws(" ", "title", "keywords"))
    rows = q.union(t).where(F.col("t").isNotNull() & (F.col("t") != ""))
    rows = rows.select("entity_type", "entity_id", F.substring("t", 1, 1000).alias("content"), F.substring("t", 1, 500).alias("to_embed"))
    return rows if existing is None else rows.join(existing, ["entity_type", "entity_id"], "left_anti")
