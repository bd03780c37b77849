"""Questions and topics out of the text of a document: small functions of a text, and columns made of them."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What lines of syllabuses say.
QUESTION_MARKERS = ["контрольно-измерительные средства", "контрольно измерительные средства", "приложение 2", "примеры заданий",
                    "экзаменационные вопросы", "вопросы", "сұрақтар", "сұрақ-жауап", "сұрақ жауап"]
QUESTION_END = r"(?i)^(приложение\s*[345]|қосымша\s*[345]|тематический план|тақырыптық жоспар)"
QUESTION_ITEM = r"(?i)^(?:\d+|[а-яәіңғүұқөһa-z])[.)]\s+"
PLAN = r"(?i)(тематический план|тақырыптық жоспар|план дисциплины|пәннің тақырыптық жоспары)"
PLAN_END = r"(?i)^(приложение\s*\d+|қосымша\s*\d+|всего:?|барлығы:?|аралық бақылау|итоговый контроль)"
TOPIC_NUMBER = r"^\d+\s*[.)]\s*$"
FIGURES = r"^\d+(?:\s+\d+){0,6}$"
TASK = (r"(?i)(тақырыпты|ситуац|ауызша|жағдайлық|презентац|powerpoint|moodle|алгоритм|электронды|приложение|қосымша"
        r"|сұрақтарына жауап|оқытушы жетекшілігімен)")  # fmt: skip
HEADER = (r"(?i)^(№|п/п|бөлім|раздел|тақырып|тема|тапсырмалар|задания|дәріс|лекции|пз|сөож|сро|ср оп|па|всего часов"
          r"|барылық сағат|жалпы)$")  # fmt: skip
LABEL = (r"(?i)^(?:(?:жж|онк|био|пат|кредит\s*\d+).*|патологическая физиология|патологическая анатомия|биологическая химия"
         r"|жүйке жүйесі|патологиялық физиология|патологиялық анатомия)$")  # fmt: skip
KEYWORD_STOP = ("and in on not that he was with for it as his be at i which same we had have from one but word what were when your said"
                " there each use an they how their if will up other about out many then them these so question answer test exam"
                " student score").split()  # fmt: skip

MIN_QUESTION, MIN_FALLBACK, MIN_TITLE = 25, 40, 12
_ENDS = " \t\n-–—.;,"




def lines_of(text: str | None) -> list[str]:
    """Lines without blank ones; runs of blanks become one."""
    plain = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in re.split(r"\r\n?|\n", text or ""))
    return [x for x in plain if x]


def _distinct(texts: list[str]) -> list[str]:
    """The first of texts that are equal but for case."""
    first: dict[str, str] = {}
    for t in texts:
        first.setdefault(t.lower(), t)
    return list(first.values())


def _first(lines: list[str], test, begin: int = 0) -> int:
    return next((k for k in range(begin, len(lines)) if test(lines[k])), len(lines))


def find_numbered(text: str | None) -> list[str]:
    """Texts of ``N. ...`` paragraphs in the order 1, 2, 3, ...: a number counts at the beginning or behind a blank line.

    Other numbers belong to the text of the question they are in, as do further lines.
    """
    text = "\n".join(x.strip() for x in re.split(r"\r\n?|\n", text or ""))
    taken: list[re.Match] = []
    for m in re.finditer(r"(?:\A|(?<=\n\n)|(?<=\A\n))(\d+)\.", text):
        if int(m[1]) == len(taken) + 1:
            taken.append(m)
    ends = [m.start() for m in taken[1:]] + [len(text)] * bool(taken)
    parts = (re.sub(r"\n{3,}", "\n\n", text[m.end() : end].strip()) for m, end in zip(taken, ends, strict=True))
    return [p for p in parts if p]


def find_questions(text: str | None) -> list[str]:
    """Numbered or lettered items between a line that announces questions and an appendix.

    Without any, numbered lines of the last third and more of the text, if they are long.
    """
    lines = lines_of(text)
    marks = lambda x: any(m in x.lower() for m in QUESTION_MARKERS)
    begin = _first(lines, marks)
    end = _first(lines, lambda x: re.match(QUESTION_END, x) and not marks(x), begin)
    items = [x for x in lines[begin:end] if not marks(x) and re.match(QUESTION_ITEM, x)]
    found = [t for t in (re.sub(QUESTION_ITEM, "", x).strip() for x in items) if len(t) >= MIN_QUESTION]
    if not found:
        tail = [x for x in lines[int(len(lines) * 0.65) :] if re.match(r"\d+[.)]\s+", x)]
        found = [t for t in (re.sub(r"^\d+[.)]\s+", "", x).strip() for x in tail) if len(t) >= MIN_FALLBACK]
    return _distinct(found)


def _title(lines: list[str]) -> str:
    """Up to two of a topic's first lines, without labels of sections in front or between."""
    if len(lines) > 1 and re.match(LABEL, lines[0]):
        lines = lines[1:]
    kept = lines[:1] + [x for x in lines[1:] if not re.match(LABEL, x)]
    return " ".join(" ".join(kept[:2]).split()).strip(_ENDS)


def find_topics(text: str | None) -> list[str]:
    """Titles below the number-only lines of the course plan, until a closing line behind at least three of them."""
    lines = lines_of(text)
    lines = lines[_first(lines, lambda x: re.search(PLAN, x)) + 1 :]
    stops = [k for k, x in enumerate(lines) if re.match(TOPIC_NUMBER, x) or re.match(PLAN_END, x)]
    titles: list[str] = []
    for at, end in zip(stops, [*stops[1:], len(lines)], strict=False):
        if not re.match(TOPIC_NUMBER, lines[at]):
            if len(titles) >= 3:
                break
            continue
        own = (x for x in lines[at + 1 : end] if not (re.match(FIGURES, x) or re.search(TASK, x) or re.match(HEADER, x)))
        title = _title([x for x in (y.strip(_ENDS) for y in own) if x][:3])
        if len(title) >= MIN_TITLE:
            titles.append(title)
    return _distinct(titles)


def find_keywords(text: str | None, most: int = 50) -> list[str]:
    """Words of four letters and more, the most frequent first, of equal ones that which comes first."""
    words = (w for w in re.findall(r"[^\W_]+", (text or "").lower()) if len(w) >= 4 and w not in KEYWORD_STOP)
    return [w for w, _ in Counter(words).most_common(most)]


def topic_entries(text: str | None, discipline: str | None) -> list[dict]:
    """``code, title, keywords`` of each topic; a single one named after the discipline if there is none."""
    name = discipline or ""
    code = re.sub(r"[^A-Za-z0-9]", "", name)[:6].upper()
    entry = lambda c, t, k: {"code": f"{code}_{c}", "title": t, "keywords": ",".join(find_keywords(k, 10))}
    found = [entry(f"T{k}", t, t) for k, t in enumerate(find_topics(text), 1)]
    return found or [entry("AUTO", f"{name} - Main Course", text)]


def _texts(function):
    def kernel(texts: pa.Array) -> pa.Array:
        return pa.array([function(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(kernel, "array<string>")


def numbered_questions(text: Column) -> Column:
    return _texts(find_numbered)(text)


def syllabus_questions(text: Column) -> Column:
    return _texts(find_questions)(text)


def syllabus_topics(docs: DataFrame, text: str, discipline: str) -> DataFrame:
    """Adds ``topics``, an array of ``code, title, keywords``, to docs."""

    def kernel(texts: pa.Array, names: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), names.to_pylist(), strict=True)
        kind = pa.struct([(c, pa.string()) for c in ("code", "title", "keywords")])
        return pa.array([topic_entries(t, n) for t, n in rows], pa.list_(kind))

    column = F.arrow_udf(kernel, "array<struct<code: string, title: string, keywords: string>>")
    return docs.withColumn("topics", column(text, discipline))


class _Numbered:
    def eval(self, text: str):
        yield from enumerate(find_numbered(text), 1)


class _Questions:
    def eval(self, text: str):
        yield from enumerate(find_questions(text), 1)


class _Topics:
    def eval(self, text: str, discipline: str):
        for k, entry in enumerate(topic_entries(text, discipline), 1):
            yield k, entry["code"], entry["title"], entry["keywords"]


class _Keywords:
    def eval(self, text: str, most: int):
        yield from enumerate(find_keywords(text, most), 1)


#: The parsers as table functions: a class with the columns of its rows for each name in SQL.
TABLE_FUNCTIONS = {
    "numbered_questions": (_Numbered, "position int, text string"),
    "syllabus_questions": (_Questions, "position int, text string"),
    "syllabus_topics": (_Topics, "position int, code string, title string, keywords string"),
    "text_keywords": (_Keywords, "position int, word string"),
}


def register_parsers(spark: SparkSession) -> None:
    """Makes the parsers table functions of the session: ``FROM docs, LATERAL numbered_questions(docs.text)``.

    A row leaves for each thing found, in batches of Arrow, without an array of all of them; a text without any has no row.
    """
    for name, (parser, columns) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(parser, returnType=columns, useArrow=True))
