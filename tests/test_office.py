"""Office files made here, read as page rows."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from atomloom.operators import chunking
from atomloom.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def rels(**targets):
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(paragraphs):
    return archive({"word/document.xml": f"<w:document {W}><w:body>" + "".join(f"<w:p>{p}</w:p>" for p in paragraphs) + "</w:body></w:document>"})


def run(text):
    return f"<w:r><w:t>{text}</w:t></w:r>"


def pptx(texts, order=None):
    names = [f"s{k}" for k in range(len(texts))]
    parts = {"ppt/presentation.xml": f'<p:presentation xmlns:p="p" {R}><p:sldIdLst>' + "".join(f'<p:sldId r:id="{n}"/>' for n in order or names) + "</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": rels(**{n: f"slides/slide{k + 1}.xml" for k, n in enumerate(names)})}
    for k, lines in enumerate(texts):
        parts[f"ppt/slides/slide{k + 1}.xml"] = f'<p:sld xmlns:p="p" {A}>' + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in lines) + "</p:sld>"
    return archive(parts)


def xlsx(rows, strings=("name", "caf&#233;")):
    cells = lambda k, row: "".join(f'<c r="{chr(65 + j)}{k}" t="{t}">{f"<is><t>{v}</t></is>" if t == "inlineStr" else f"<v>{v}</v>"}</c>' for j, t, v in row)
    return archive({
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="First" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(a="worksheets/sheet1.xml", b="/xl/worksheets/sheet2.xml"),
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" if "&" not in s else f"<si><t>{s}</t></si>" for s in strings) + "</sst>",
        "xl/worksheets/sheet1.xml": "<worksheet><sheetData>" + "".join(f'<row r="{k}">{cells(k, row)}</row>' for k, row in enumerate(rows, 1)) + "</sheetData></worksheet>", "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
    })


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(office.OfficePages)
    at = tmp_path_factory.mktemp("office")
    (at / "deep").mkdir()
    files = {
        "two.docx": docx([run("First ") + run("paragraph."), run("Second &amp; last") + '<w:r><w:br w:type="page"/></w:r>' + run("On page two."), "<w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r>"]),
        "deep/slides.PPTX": pptx([["Title one", "a line"], ["Title two"], []], order=["s1", "s0", "s2"]),
        "table.xlsx": xlsx([[(0, "s", 0), (1, "s", 1)], [(0, "n", 1.5), (3, "b", 1)], [(1, "inlineStr", "in\tline")]]),
        "long.xlsx": xlsx([[(0, "n", k)] for k in range(1201)]),
        "nothing.docx": b"", "text.docx": b"this is no archive", "cut.docx": docx([run("x" * 9000)])[:-300], "missing.pptx": archive({"other.xml": "<x/>"}),
        "xml.docx": archive({"word/document.xml": f"<w:document {W}><w:p>{run('kept')}<w:r><w:lastRenderedPageBreak/></w:r></w:p><w:p>"}), "string.xlsx": xlsx([[(0, "s", 7)]]), "other.txt": b"left out",
    }
    for name, data in files.items():
        (at / name).write_bytes(data)
    return str(at)


def test_pages_of_office_files(spark, folder):
    rows = spark.read.format("office_pages").option("path", folder).load().collect()
    good = {}
    for r in rows:
        if r.problem is None:
            good.setdefault(r.path.removeprefix(folder + "/"), []).append((r.page, r.title, r.text))
    assert sorted(good["two.docx"]) == [(0, None, "First paragraph.\nSecond & last"), (1, None, "On page two.\na\tb")]
    assert sorted(good["deep/slides.PPTX"]) == [(0, "Title two", "Title two"), (1, "Title one", "Title one\na line"), (2, None, "")]
    assert sorted(good["table.xlsx"]) == [(0, "First", "name\tcafé\n1.5\t\t\tTRUE\n\tin line"), (1, "Empty", "")]
    assert [(p, t.count("\n") + 1) for p, _, t in sorted(good["long.xlsx"])] == [(0, 500), (1, 500), (2, 201), (3, 1)]
    problems = {r.path.removeprefix(folder + "/"): r for r in rows if r.problem}
    assert set(problems) == {"nothing.docx", "text.docx", "cut.docx", "missing.pptx", "xml.docx", "string.xlsx"}
    assert good["xml.docx"] == [(0, None, "kept")] and problems["xml.docx"].page == 1 and "missing" in problems["missing.pptx"].problem
    assert not any("other.txt" in r.path for r in rows)


def test_partitions_follow_sizes_and_filters_leave_files_out(spark, folder):
    reader = office.FilteredReader(spark.read.format("office_pages").option("path", folder).load().schema, {"path": folder, "partbytes": "4000"})
    parts = [p.files for p in reader.partitions()]
    assert len(parts) > 1 and len({f for p in parts for f in p}) == sum(map(len, parts)) == 10
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("kind",), "pptx"), GreaterThan(("page",), 0)]))
    assert left == [GreaterThan(("page",), 0)] and {k for p in reader.partitions() for _, k in p.files} == {"pptx"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert spark.read.format("office_pages").option("path", folder).option("pushFilters", "true").load().where("kind = 'pptx' and problem is null").count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format("office_pages").option("path", folder).load().where("kind = 'pptx' and problem is null").count() == 3
    assert spark.read.format("office_pages").option("path", folder + "/nowhere").load().count() == 0


def test_a_part_that_unpacks_without_end_is_a_problem(monkeypatch):
    monkeypatch.setattr(office, "MOST", 100_000)
    data = docx([run("y" * 1000)] * 50 + ["<w:r><w:lastRenderedPageBreak/></w:r>"] + [run("z" * 1000)] * 5000)
    found = list(office.pages_of(io.BytesIO(data), "docx"))
    assert found[0][3] is None and found[0][2].startswith("yyy") and "bytes" in found[-1][3]


def test_pages_go_on_to_the_chunkers(spark, folder):
    pages = spark.read.format("office_pages").option("path", folder).load().where("problem is null").select(F.col("path").alias("doc_id"), "page", "text")
    atoms = chunking.page_atoms(pages)
    assert atoms.count() == pages.where("trim(text) <> ''").count()
