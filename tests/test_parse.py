import io
import zipfile

from corpusloom.operators import parse as p
from corpusloom.sources import tables


def test_files(spark, tmp_path):
    (tmp_path / "ab12cd34_name.txt").write_bytes(b"ok \xff end")
    (tmp_path / "skip.exe").write_bytes(b"x")
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for name in ("word/media/a.png", "word/media/sub/a.png", "word/document.xml"):
            z.writestr(name, b"123")
    (tmp_path / "d.docx").write_bytes(box.getvalue())
    files = p.scan_files(spark, str(tmp_path))
    assert {(r.filename, r.original, r.ext) for r in files.collect()} == {("ab12cd34_name.txt", "name.txt", ".txt"), ("d.docx", "d.docx", ".docx")}
    text = p.parse_text(files.where("ext = '.txt'")).first()
    assert text.content == "# ab12cd34_name\n\nok � end" and text.char_count == len(text.content)
    media = sorted((r.filename, r.size, r.source) for r in p.media_inventory(files).collect())
    assert media == [("a.png", 3, "word/media/a.png"), ("a_1.png", 3, "word/media/sub/a.png")]


def test_rows_to_markdown(spark):
    rows = [
        (1, "book", "S", 1, 0, ["h1", "h2"]), (1, "book", "S", 1, 1, ["a"]), (1, "book", "S", 1, 2, [None, ""]), (1, "book", "S", 1, 3, ["Head：", None]),
        (1, "book", "S", 1, 4, ["x", "y", "z"]), (1, "book", "Empty", 2, 0, ["", None]),
    ]
    got = p.rows_to_markdown(spark.createDataFrame(rows, "doc_id long, stem string, sheet string, sheet_no int, row_no int, cells array<string>")).first().content
    assert got == "# book\n\n## S\n\n| h1 | h2 |\n| --- | --- |\n\n### a\n\n### Head\n\n| x | y | z |\n| --- | --- | --- |\n\n## Empty\n\n（空表）\n"


def test_elements(spark):
    run = lambda t, b=False, i=False: (t, b, i)
    rows = [
        (1, 0, "p", "Heading 2", None, [run("Title")], None), (1, 1, "p", "标题 9", None, [run("T")], None), (1, 2, "p", "Normal", 0, [run("O")], None),
        (1, 3, "p", "Normal", None, [run("a "), run("b", True, True), run("c", True), run("d", False, True)], None), (1, 4, "p", "", None, [run("  ")], None),
        (1, 5, "table", None, None, None, [["a", "b\nc"], ["d"], ["", " "]]),
    ]
    schema = "doc_id long, seq int, kind string, style string, outline_level int, runs array<struct<text:string,bold:boolean,italic:boolean>>, rows array<array<string>>"
    got = p.elements_to_markdown(spark.createDataFrame(rows, schema)).first().content
    assert got == "## Title\n\n###### T\n\n# O\n\na ***b*****c***d*\n\n| a | b c |\n| --- | --- |\n| d |  |\n"


def test_tables(spark, tmp_path):
    (tmp_path / "syn.txt").write_text("# c\n\na = x\nb=y=z\na= w\n", encoding="utf-8")
    assert sorted((r.alias, r.canonical) for r in tables.read_synonyms(spark, str(tmp_path / "syn.txt")).collect()) == [("a", "w"), ("b", "y=z")]
    (tmp_path / "rules.json").write_text('[{"pattern": "a", "replacement": "b"}, {"pattern": "c"}]')
    assert tables.read_rules(spark, str(tmp_path / "rules.json")) == [("a", "b")]
    chunks = spark.createDataFrame([(1, "k", "f", "s", "t", "c", "NL", True, ["p", "q"], None)], "chunk_index long, category string, source_file string, section_path string, content_type string, content string, split_strategy string, has_image boolean, image_ids array<string>, enriched_content string")
    tables.write_chunks_jsonl(chunks, str(tmp_path / "out"))
    assert tables.read_chunks_jsonl(spark, str(tmp_path / "out")).first().image_ids == ["p", "q"]
