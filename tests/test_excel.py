"""Workbooks written here, cell by cell, read back typed."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from tallywright.functions import scalars as sc
from tallywright.sources import excel, files

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def write_book(path, sheet_rows, shared, dimension="A1:Z9", second=""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {NS}><sheets><sheet name="B" sheetId="7" r:id="rId9"/><sheet name="A" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"{HEAD}<worksheet {NS}><sheetData>{second}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'{HEAD}<worksheet {NS}>{f"""<dimension ref="{dimension}"/>""" if dimension else ""}<sheetData>{"".join(sheet_rows)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>{''.join(f'<si><t>{escape(s)}</t></si>' if not s.startswith('<') else f'<si>{s}</si>' for s in shared)}</sst>")


def s(ref, n):
    return f'<c r="{ref}" t="s"><v>{n}</v></c>'


def v(ref, value, kind=""):
    return f'<c r="{ref}"{kind and f" t={chr(34)}{kind}{chr(34)}"}><v>{value}</v></c>'


def row(n, *cells):
    return f'<row r="{n}">{"".join(cells)}</row>'


def test_cell_kinds_headers_and_blank_rows(spark, tmp_path):
    shared = ["Name", "Rate", "<r><t>Two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh>", "Ann & Bob", ""]
    rows = [
        row(2, s("B2", 0), s("C2", 1), s("D2", 0), '<c r="F2" t="inlineStr"><is><t>On</t></is></c>', v("G2", "formula", "str")),
        row(3, s("B3", 3), v("C3", "12.50"), v("D3", "1E3"), v("E3", "0.1"), v("F3", "1", "b"), v("G3", "x y", "str")),
        row(4), row(5, '<c r="B5" s="3"/>'),
        row(7, s("B7", 2), v("C7", "#DIV/0!", "e"), v("F7", "0", "b"), v("H7", "9")),
    ]
    write_book(tmp_path / "a.xlsx", rows, shared)
    df = excel.read_excel(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["Name", "Rate", "Name_1", "__EMPTY", "On", "formula"]
    assert sorted(tuple(r) for r in df.collect()) == [("Ann & Bob", "12.5", "1000", "0.1", "true", "x y"), ("Two runs", "", "", "", "false", "")]
    assert files.read_any(spark, str(tmp_path / "a.xlsx")).count() == 2


@pytest.mark.parametrize("dimension", ["A1:C5001", "A1:C3", None])
def test_many_tasks_and_types(spark, tmp_path, dimension):
    shared = ["Key", "Day", "Cost"] + [f"{1 + i % 28:02d}/03/2024" for i in range(5000)]
    rows = [row(1, s("A1", 0), s("B1", 1), s("C1", 2))] + [row(i + 2, v(f"A{i + 2}", i), s(f"B{i + 2}", i + 3), v(f"C{i + 2}", i / 4)) for i in range(5000)]
    write_book(tmp_path / "b.xlsx", rows, shared, dimension)
    df = excel.read_excel(spark, str(tmp_path / "b.xlsx"), rows_per_task=800)
    assert df.rdd.getNumPartitions() == (7 if dimension == "A1:C5001" else 1)
    kinds = files.infer_types(df)
    assert kinds == {"Key": "currency", "Day": "date", "Cost": "currency"} or kinds == {"Key": "number", "Day": "date", "Cost": "number"}
    typed = df.select(*[sc.coerce_detected(df[c], k).alias(c) for c, k in kinds.items()])
    got = sorted(typed.collect())
    assert [(r["Key"], r["Cost"], r["Day"].day) for r in got] == [(float(i), i / 4, 1 + i % 28) for i in range(5000)]


def test_a_folder_of_workbooks_and_an_empty_one(spark, tmp_path):
    for i in range(3):
        write_book(tmp_path / f"{i}.xlsx", [row(1, s("A1", 0), s("B1", 1)), row(2, v("A2", i), s("B2", 2))], ["id", "name", f"n{i}"])
    assert sorted(tuple(r) for r in excel.read_excel(spark, str(tmp_path)).collect()) == [("0", "n0"), ("1", "n1"), ("2", "n2")]
    (tmp_path / "none").mkdir()
    write_book(tmp_path / "none" / "e.xlsx", [], [])
    assert excel.read_excel(spark, str(tmp_path / "none" / "e.xlsx")).collect() == []
