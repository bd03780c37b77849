"""Questions against their syllabus topics: coverage, tf-idf alignment, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..coefficients import DEFAULT, Coefficients
from ..functions.stats import rounded
from ..functions.text import STOP_WORDS, frequencies, tokens, weighted
from ..functions.vectors import cosine
from .store import settled


def _attempts(facts: DataFrame) -> DataFrame:
    """``import_id, question_id, mean, students``."""
    rows = facts.where(F.col("question_id").isNotNull())
    return rows.groupBy("import_id", "question_id").agg(F.avg("received_score").alias("mean"), F.countDistinct("student_id").alias("students"))


def _topic_text():
    return F.concat_ws(" ", "title", "keywords")


def questions_for_analysis(facts: DataFrame, questions: DataFrame, topics: DataFrame) -> DataFrame:
    """Linked questions of each import with their topics, mean (0 without scores) and students."""
    linked = questions.join(topics.select("syllabus_topic_id", "title", "discipline_name"), "syllabus_topic_id")
    own = _attempts(facts).join(linked, "question_id")
    mean = rounded(F.coalesce("mean", F.lit(0.0)), 2)
    return own.select("import_id", "question_id", "syllabus_topic_id", "title", "discipline_name", mean.alias("avg_score"), "students")


def _share(question: Column, c: Coefficients) -> Column:
    """Share of a topic's distinct tokens (``reference``) that are in the question; 0 if either has none. In percent."""
    found = F.size(F.array_intersect("reference", tokens(question, c.min_token_length, STOP_WORDS)))
    return rounded(100 * F.when(F.size("reference") == 0, 0.0).otherwise(found / F.size("reference")), 1)


def _with_reference(topics: DataFrame, c: Coefficients) -> DataFrame:
    """The topics and their distinct tokens, made once for all questions and written, so that Spark knows how few they are."""
    return settled(topics.withColumn("reference", F.array_distinct(tokens(_topic_text(), c.min_token_length, STOP_WORDS))))


def keyword_coverage(questions: DataFrame, topics: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    rows = questions.join(_with_reference(topics, c), "syllabus_topic_id")
    return rows.select("question_id", _share(F.col("question_text"), c).alias("keyword_coverage"))


def pair_cosine(a: str, b: str):
    """Cosine of two token arrays under the weights of these two texts alone, tf * ln(2 / df); 0 where one has no weight."""
    tf = lambda tokens_, w: F.size(F.filter(tokens_, lambda x: x == w)) / F.size(tokens_)
    df = lambda w: F.array_contains(a, w).cast("int") + F.array_contains(b, w).cast("int")
    of = lambda tokens_: lambda w: tf(F.col(tokens_), w) * F.log(F.lit(2.0) / df(w))
    total = lambda words, f: F.aggregate(words, F.lit(0.0), lambda acc, w: acc + f(w))
    dot = total(F.array_intersect(a, b), lambda w: of(a)(w) * of(b)(w))
    norm = F.sqrt(total(F.array_distinct(a), lambda w: of(a)(w) * of(a)(w)) * total(F.array_distinct(b), lambda w: of(b)(w) * of(b)(w)))
    return F.when(norm > 0, dot / norm).otherwise(0.0)


def text_similarity(questions: DataFrame, topics: DataFrame, mode: str = "corpus") -> DataFrame:
    """``question_id, similarity``: cosine of a question with its topic.

    corpus: idf over all question and topic texts. faithful: idf over the two texts alone, ln(2 / df),
    under which words in common weigh nothing.
    """
    of = lambda text: tokens(text, 2, STOP_WORDS)
    if mode == "faithful":
        rows = questions.join(topics, "syllabus_topic_id").select("question_id", of(F.col("question_text")).alias("a"), of(_topic_text()).alias("b"))
        return rows.select("question_id", pair_cosine("a", "b").alias("similarity"))
    words = questions.select("question_id", "syllabus_topic_id", of(F.col("question_text")).alias("tokens"))
    own = settled(topics.select(F.col("syllabus_topic_id").alias("id"), of(_topic_text()).alias("tokens")))
    known = settled(frequencies(words.select("tokens").union(own.select("tokens"))))
    of_topics = settled(weighted(own, known)).select(F.col("id").alias("syllabus_topic_id"), "token", "weight")
    # dealt by question once: what follows stays in place while tokens and topics are small
    rows = words.join(own.select(F.col("id").alias("syllabus_topic_id")), "syllabus_topic_id").repartition("question_id")
    rows = rows.select("question_id", "syllabus_topic_id", F.explode_outer("tokens").alias("token"))
    rows = rows.groupBy("question_id", "syllabus_topic_id", "token").agg(F.count("*").alias("tf"))
    rows = rows.join(known.select("token", "idf"), "token", "left").join(of_topics, ["syllabus_topic_id", "token"], "left")
    w = F.col("tf") * F.col("idf")
    sums = rows.groupBy("question_id").agg(F.sum(w * F.col("weight")).alias("dot"), F.sqrt(F.sum(w * w)).alias("norm"))
    return sums.select("question_id", F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)).alias("similarity"))


def semantic_similarity(questions: DataFrame, topics: DataFrame, of_questions: DataFrame, of_topics: DataFrame) -> DataFrame:
    """``question_id, semantic``: cosine of the vectors of a question and its topic (``question_id, vector`` and ``syllabus_topic_id, vector``).

    Questions without a topic, or of which either has no vector, have no row: for them there are no embeddings.
    """
    rows = questions.join(topics.select("syllabus_topic_id"), "syllabus_topic_id").select("question_id", "syllabus_topic_id")
    rows = rows.join(of_questions.select("question_id", F.col("vector").alias("a")), "question_id")
    rows = rows.join(of_topics.select("syllabus_topic_id", F.col("vector").alias("b")), "syllabus_topic_id")
    return rows.select("question_id", cosine(F.col("a"), F.col("b")).alias("semantic")).where(F.col("semantic").isNotNull())


def linked_texts(
    questions: DataFrame, topics: DataFrame, semantic: DataFrame | None = None, c: Coefficients = DEFAULT, mode: str = "corpus"
) -> DataFrame:
    """Linked questions with their topics: what alignment and validation look at besides the facts, the same for all imports.

    ``question_id, max_score, similarity, keyword_coverage, semantic`` (null: no vectors) and the topic's columns.
    """
    topics = _with_reference(topics, c)
    of_topic = [x for x in ("title", "topic_code", "discipline_name") if x in topics.columns]
    of_question = [x for x in ("max_score",) if x in questions.columns]
    rows = questions.select("question_id", "question_text", "syllabus_topic_id", *of_question)
    rows = rows.join(topics.select("syllabus_topic_id", "reference", *of_topic), "syllabus_topic_id")
    rows = rows.select("question_id", "syllabus_topic_id", *of_topic, *of_question, _share(F.col("question_text"), c).alias("keyword_coverage"))
    rows = rows.join(text_similarity(questions, topics, mode), "question_id")
    if semantic is None:
        return rows.withColumn("semantic", F.lit(None).cast("double"))
    return rows.join(semantic.select("question_id", "semantic"), "question_id", "left")


def _combined(c: Coefficients) -> Column:
    semantic = F.coalesce(F.nanvl("semantic", F.lit(0.0)), F.lit(0.0))
    return rounded(c.text_weight * F.col("similarity") + c.semantic_weight * semantic, 3)


def alignment(
    facts: DataFrame, questions: DataFrame, topics: DataFrame, semantic: DataFrame | None = None,
    c: Coefficients = DEFAULT, mode: str = "corpus",
) -> DataFrame:
    """Text and semantic similarity of each import's linked questions with their topics, and its level.

    semantic: ``question_id, semantic``; without it, as without an embedding service, it is 0.
    """
    return alignment_of(_attempts(facts), linked_texts(questions, topics, semantic, c, mode), c)


def alignment_of(attempts: DataFrame, texts: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """alignment from each import's questions (``import_id, question_id, mean, students``) and linked_texts."""
    rows = attempts.join(texts, "question_id").withColumn("combined_score", _combined(c))
    value = F.col("combined_score")
    level = F.when(value < c.alignment_low, "low").when(value < c.alignment_medium, "medium").otherwise("high")
    return rows.select(
        "import_id", "question_id", "syllabus_topic_id", "title", "discipline_name", rounded(F.col("similarity"), 3).alias("text_similarity"),
        rounded(F.coalesce(F.nanvl("semantic", F.lit(0.0)), F.lit(0.0)), 3).alias("semantic_similarity"), "combined_score", level.alias("alignment_level"),
        rounded(F.coalesce("mean", F.lit(0.0)), 2).alias("average_score"), F.col("students").alias("student_attempts"),
    )


def validation(
    facts: DataFrame, questions: DataFrame, topics: DataFrame, semantic: DataFrame | None = None, c: Coefficients = DEFAULT
) -> DataFrame:
    """The linked questions of each import: statistics, coverage, alignment, and what is wrong with them.

    Attempts are distinct students; a question without scores has the mean 0, one without a maximum
    the default one. NO_EMBEDDINGS: semantic (``question_id, semantic``) has nothing on the question.
    """
    return validation_of(_attempts(facts), linked_texts(questions, topics, semantic, c), c)


def validation_of(attempts: DataFrame, texts: DataFrame, c: Coefficients = DEFAULT) -> DataFrame:
    """validation from each import's questions (``import_id, question_id, mean, students``) and linked_texts."""
    maximum = F.coalesce("max_score", F.lit(c.default_maximum))
    mean = F.coalesce("mean", F.lit(0.0))
    rows = attempts.join(texts, "question_id").withColumn("aligned", _combined(c))
    tried = F.col("students") > 0
    issues = F.array_compact(
        F.array(
            F.when(tried & (mean < c.validation_low * maximum), "LOW_AVG"),
            F.when(tried & (mean > c.validation_high * maximum), "HIGH_AVG"),
            F.when(F.col("students") < c.validation_attempts, "FEW_ATTEMPTS"),
            F.when(F.col("semantic").isNull(), "NO_EMBEDDINGS"),
        )
    )
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    combined = 0.3 * zero("keyword_coverage") + 0.4 * 100 * zero("aligned") + 0.3 * 100 * zero("semantic")
    return rows.select(
        "import_id", "question_id", "title", "topic_code", zero("keyword_coverage").alias("keyword_coverage"),
        rounded(100 * zero("aligned"), 1).alias("tfidf_score"), rounded(100 * zero("semantic"), 1).alias("semantic_similarity"),
        rounded(combined, 1).alias("combined_score"), rounded(mean, 2).alias("avg_score"), F.col("students").alias("attempts"),
        F.array_join(issues, ",").alias("issues"), F.when(F.size(issues) > 0, "warning").otherwise("ok").alias("status"),
    )


def validate_one(facts: DataFrame, questions: DataFrame, topics: DataFrame, question_id: int, c: Coefficients = DEFAULT) -> DataFrame:
    """validation of a single question; the filter comes before the figures."""
    of = F.col("question_id") == question_id
    return validation(facts.where(of), questions.where(of), topics, None, c)


#: Words of doses and drugs in a question (fixed values, Russian).
DOSES = r"(?iU)\b(мг|мкг|доз|дозиров|препарат)"


def rubric_compliance(questions: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Questions (``question_id, question_text, rubric_id``) against their rubrics (``rubric_id, title, criteria_text, dose_theme_note``).

    overlap counts the rubric's lines whose first twenty characters are in the question. DOSES_STRESSED:
    the rubric has a note on doses, and the question doesn't speak of any.
    """
    rows = questions.join(rubrics, "rubric_id")
    question = F.coalesce("question_text", F.lit(""))
    lines = F.filter(F.transform(F.split(F.coalesce("criteria_text", F.lit("")), r"\R+"), lambda x: F.trim(x)), lambda x: x != "")
    overlap = F.size(F.filter(lines, lambda x: F.lower(question).contains(F.lower(F.substring(x, 1, 20)))))
    noted = F.coalesce("dose_theme_note", F.lit("")) != ""
    issues = F.array(
        F.when(F.length(question) <= 40, "SHORT_TEXT"),
        F.when(noted & ~question.rlike(DOSES), "DOSES_STRESSED"),
    )
    return rows.select("question_id", F.col("title").alias("rubric_title"), overlap.alias("overlap"), F.array_join(F.array_compact(issues), ",").alias("issues"))
