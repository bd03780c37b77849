import io
import tracemalloc
import zipfile

from pyspark.sql import functions as F

from itemlab.functions import parsing
from itemlab.sources import files


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Question ID;Балл;c\n 1 ;"7,5;x"; -\n;;\n2;"a ""q""";\n'.encode())
    rows = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["Question ID", "Балл", "c"]
    assert [tuple(r) for r in rows.collect()] == [("1", "7,5;x", "-"), ("2", 'a "q"', None)]
    assert files.sniff("a,b\tc\td") == "\t" and files.sniff("abc") == ";"


def test_spreadsheets(spark, tmp_path):
    sheet = ('<worksheet xmlns="x"><sheetData><row/><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Score</t></is></c></row>'
             '<row><c r="A2"><v>12</v></c><c r="C2" t="s"><v>1</v></c></row></sheetData></worksheet>')  # fmt: skip
    shared = '<sst xmlns="x"><si><t>ID</t></si><si><r><t>7</t></r><r><t>,5</t></r></si></sst>'
    (tmp_path / "a.xlsx").write_bytes(archive(xl__worksheets__sheet1=sheet, xl__sharedStrings=shared))
    table = "".join(f"<table-row>{c}</table-row>" for c in (
        '<table-cell number-columns-repeated="3"/>', "<table-cell><p>ID</p></table-cell><table-cell><p>A &amp; B</p></table-cell><table-cell><p>C</p></table-cell>",
        '<table-cell><p>1</p></table-cell><table-cell number-columns-repeated="2"><p>x</p></table-cell><table-cell number-columns-repeated="16000"/>'))
    (tmp_path / "b.ods").write_bytes(archive(content=f"<doc><table>{table}</table></doc>"))
    got = {r.path[-6:]: r.cells for r in files.read_spreadsheets(spark, str(tmp_path)).collect()}
    assert got == {"a.xlsx": {"ID": "12", "Score": "7,5"}, "/b.ods": {"ID": "1", "A & B": "x", "C": "x"}}
    assert files.column_index("AB7") == 27


def test_sheets_are_read_a_row_at_a_time(spark, tmp_path, monkeypatch):
    n = 60_000
    rows = "".join(f'<row><c r="A{k}"><v>{k}</v></c><c r="B{k}" t="inlineStr"><is><t>text {k}</t></is></c><c r="C{k}"><v>7</v></c></row>' for k in range(n))
    content = archive(xl__worksheets__sheet1=f'<worksheet><sheetData><row><c t="inlineStr"><is><t>id</t></is></c><c t="inlineStr"><is><t>name</t></is></c><c t="inlineStr"><is><t>c</t></is></c></row>{rows}</sheetData></worksheet>')
    cells = "".join(f"<table-row><table-cell><p>{k}</p></table-cell><table-cell><p>text {k}</p></table-cell></table-row>" for k in range(n))
    ods = archive(content=f"<doc><table><table-row><table-cell><p>id</p></table-cell><table-cell><p>name</p></table-cell></table-row>{cells}</table><table><table-row><table-cell><p>other</p></table-cell></table-row></table></doc>")
    for read, data in ((files.xlsx_rows, content), (files.ods_rows, ods)):
        tracemalloc.start()
        assert sum(1 for _ in read(data)) == n + 1
        assert tracemalloc.get_traced_memory()[1] < 8_000_000  # a tree of all rows takes over ten times that
        tracemalloc.stop()
    (tmp_path / "big.xlsx").write_bytes(content)
    some = files.read_spreadsheets(spark, str(tmp_path), columns=["name"], limit=25)
    assert [(r.row, r.cells) for r in some.collect()] == [(k + 1, {"name": f"text {k}"}) for k in range(25)]
    monkeypatch.setattr(files, "SHEET_ROWS", 1000)
    whole = files.read_spreadsheet(spark, str(tmp_path / "big.xlsx"))
    assert whole.columns == ["row", "id", "name", "c"] or sorted(whole.columns) == ["c", "id", "name", "row"]
    assert tuple(whole.agg(F.count("*"), F.sum(F.col("id").cast("long")), F.max("row")).first()) == (n, n * (n - 1) // 2, n)


def test_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(archive(word__document="<w:p>One &amp; two</w:p><w:tr><w:tc>a</w:tc><w:tc>b</w:tc></w:tr>"))
    (tmp_path / "b.odt").write_bytes(archive(content="<text:h>Head</text:h><text:p>Body</text:p>"))
    (tmp_path / "c.txt").write_bytes("Вопрос\r\nдва".encode("cp1251"))
    (tmp_path / "d.pdf").write_bytes(b"%PDF\nBT (Hello) Tj ET\nBT (World) Tj\n")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.path[-6:]: r.text for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "One & two\na\tb", "/b.odt": "Head\nBody", "/c.txt": "Вопрос\nдва", "/d.pdf": "Hello World", "e.docx": None}


def one(spark, function, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"c{k} string" for k in range(len(texts))))
    return df.select(function(*(F.col(c) for c in df.columns)).alias("x")).first().x


def test_numbered_questions(spark):
    text = "intro\n\n1. First\nmore\n\n\n\nstill\n\n3. not yet\n\n2. Second\n4. inside\n\n3.Third"
    assert one(spark, parsing.numbered_questions, text) == ["First\nmore\n\nstill\n\n3. not yet", "Second\n4. inside", "Third"]
    assert one(spark, parsing.numbered_questions, None) == [] == one(spark, parsing.numbered_questions, "no numbers")


def test_syllabus_questions(spark):
    long = "what is the meaning of this long question"
    text = f"1. {long} before\nЭкзаменационные вопросы\n1. {long}\nb) {long} too\n2. short\n3. {long.upper()}\nПриложение 3\n4. {long} after"
    assert one(spark, parsing.syllabus_questions, text) == [long, f"{long} too"]
    tail = "\n".join(["line"] * 7 + [f"1. {long} and longer", "2. no"])
    assert one(spark, parsing.syllabus_questions, tail) == [f"{long} and longer"]


def test_topics(spark):
    body = "\n".join(f"{k}.\nпат 1\nTitle of the topic {k}\nsecond line\n12 3" for k in range(1, 5))
    text = f"Курс\nТематический план\nТема\n{body}\nВсего\n9.\nTitle behind the end"
    rows = spark.createDataFrame([(text, "Patho logy 2"), ("nothing here here", "Bio"), (None, "X")], "body string, discipline string")
    got, auto, none = (r.topics for r in parsing.syllabus_topics(rows, "body", "discipline").collect())
    assert [t.code for t in got] == [f"PATHOL_T{k}" for k in range(1, 5)]
    assert got[0].title == "Title of the topic 1 second line"
    assert got[0].keywords == "title,topic,second,line"
    assert [t.title for t in none] == ["X - Main Course"]
    assert [tuple(t) for t in auto] == [("BIO_AUTO", "Bio - Main Course", "here,nothing")]


def test_filled_cells_are_repeated_beyond_a_thousand():
    cells = "".join(f'<table-cell number-columns-repeated="{n}">{x}</table-cell>' for n, x in ((1500, ""), (1200, "<p>x</p>"), (9000, "")))
    got = next(files.ods_rows(archive(content=f"<doc><table><table-row>{cells}</table-row></table></doc>")))
    assert len(got) == 2700 and got[1500:] == ["x"] * 1200 and not any(got[:1500])


def test_pdf_without_text():
    assert files.pdf_text(b"%PDF\nnothing") == files.NO_PDF_TEXT


def test_semicolons_before_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b;c\n1,2,3;4\n")
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    assert files.read_semicolons(spark, str(tmp_path / "a.csv")).columns == ["a,b", "c"]
    assert files.read_semicolons(spark, str(tmp_path / "b.csv")).columns == ["a", "b"]


def test_parsers_as_table_functions(spark):
    """Each table function gives the rows of its array, in SQL with a lateral join."""
    parsing.register_parsers(spark)
    texts = ["1. First\nmore\n\n2. Second", "", None, "words words letters"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    sql = lambda call: sorted(tuple(r) for r in spark.sql(f"SELECT d.id, x.* FROM {{docs}} d, LATERAL {call} x", docs=docs).collect())
    assert sql("numbered_questions(d.body)") == [(0, 1, "First\nmore"), (0, 2, "Second")]
    assert sql("syllabus_questions(d.body)") == sorted((k, n, q) for k, t in enumerate(texts) for n, q in enumerate(parsing.find_questions(t), 1))
    assert [r[:3] for r in sql("text_keywords(d.body, 1)") if r[0] == 3] == [(3, 1, "words")]
    topics = sorted((k, n, *e.values()) for k, t in enumerate(texts) for n, e in enumerate(parsing.topic_entries(t, "Anatomy"), 1))
    assert sql("syllabus_topics(d.body, 'Anatomy')") == topics
