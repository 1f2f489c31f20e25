"""Sheets and text documents, from files made by hand."""

import io
import zipfile

from weftgraph.sources import office

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(sheets, shared=()):
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets))
    links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
    parts = {"xl/workbook.xml": f"<workbook {NS}><sheets>{names}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>", "xl/sharedStrings.xml": f"<sst {NS}>" + "".join(f"<si><t>{t}</t></si>" for t in shared) + "</sst>"}
    for i, (_, cells) in enumerate(sheets):
        parts[f"xl/worksheets/s{i}.xml"] = f"<worksheet {NS}><sheetData>" + "".join(f"<row>{c}</row>" for c in cells) + "</sheetData></worksheet>"
    return packed(**parts)


def test_sheets(spark):
    one = [
        '<c r="B2" t="s"><v>0</v></c><c r="AA2"><v>3.5</v></c>',
        '<c r="C4" t="b"><v>1</v></c>',
        '<c r="A8" t="inlineStr"><is><t>x|y\nz</t></is></c>',
        '<c r="A9"/>',
    ]
    book = workbook([("Data", one), ("My 'own'", ['<c r="A1" t="str"><v>f</v></c>'])], ["head"])
    items = spark.createDataFrame([("a.xlsx", book), ("bad.xlsx", b"no"), ("none.xlsx", workbook([("S", [])]))], "name string, content binary")
    found = office.cells(items)
    assert {r.name: r.reason[:22] for r in found.filter("reason is not null").collect()} == {"bad.xlsx": "cannot read workbook: ", "none.xlsx": "workbook has no non-em"}
    units = [tuple(r)[1:] for r in office.sheet_units(found).orderBy("name", "position").collect()]
    assert [u[:3] for u in units] == [(1, "a.xlsx#Data!B2:AA4", ["Data"]), (2, "a.xlsx#Data!A8:A8", ["Data"]), (3, "a.xlsx#'My ''own'''!A1:A1", ["My 'own'"])]
    lines = units[0][3].split("\n")
    assert lines[0].startswith("| | B | C |") and lines[0].endswith("| Z | AA |") and len(lines) == 5
    assert lines[2].startswith("| 2 | head |") and lines[2].endswith("| 3.5 |") and lines[3].replace("|", "").split() == ["3"] and "| TRUE |" in lines[4]
    assert units[1][3] == "| | A |\n|---|---|\n| 8 | x\\|y z |"
    letters = spark.createDataFrame([(n,) for n in (1, 26, 27, 52, 702, 703, 16384)], "n int").select(office.column_letters(office.F.col("n")))
    assert [r[0] for r in letters.collect()] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]


def test_documents():
    def par(text, style=None):
        return f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"

    def document(*pars):
        return packed(**{"word/document.xml": '<w:document xmlns:w="http://w"><w:body>' + "".join(pars) + "</w:body></w:document>"})

    plain = office.document_units("a.docx", document(*[par(f"p{k}") for k in range(17)]))
    assert [u[0] for u in plain] == ["a.docx#para=1-15", "a.docx#para=16-17"] and plain[1][2] == "p15\n\np16"
    titled = office.document_units("b.docx", document(par("before"), par("One", "Heading1"), par("text"), par("Two", "Heading2"), par("Three", "Heading2"), par("more")))
    assert titled == [("b.docx#para=1-1", [], "before"), ("b.docx#heading=One", ["One"], "text"), ("b.docx#heading=One > Three", ["One", "Three"], "more")]
