"""Small workbooks without third-party packages: cells of .xlsx files, and a writer for capped result sheets."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
#: Data rows of one sheet at most.
SHEET_ROWS = 1_048_575


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def read_sheets(path: str) -> dict[str, list[list[str | None]]]:
    """Every sheet's rows of cell texts, by name in order."""
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in x.iter(f"{{{_NS['m']}}}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet"):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows = []
            for row in root.iter(f"{{{_NS['m']}}}row"):
                cells: list[str | None] = []
                for c in row.findall("m:c", _NS):
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    value = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        cells[k] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif value is not None:
                        cells[k] = shared[int(value.text)] if c.get("t") == "s" else value.text
                rows.append(cells)
            out[sheet.get("name")] = rows
    return out


def _cell(ref: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    # Inline text is never run as a formula.
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def chunks(name: str, rows: list) -> dict[str, list]:
    """A sheet's rows over as many sheets as they need."""
    parts = [rows[k : k + SHEET_ROWS] for k in range(0, len(rows), SHEET_ROWS)] or [[]]
    return {name if k == 0 else f"{name}_{k + 1}": part for k, part in enumerate(parts)}


def write_sheets(path: str, sheets: dict[str, tuple[list[str], list]]) -> None:
    """A workbook of (header, rows) by sheet name."""
    pages = [(n, head, part) for name, (head, rows) in sheets.items() for n, part in chunks(name, rows).items()]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(pages) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>')
        book.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        named = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _, _) in enumerate(pages, 1))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>{named}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(pages) + 1)) + "</Relationships>")
        for k, (_, head, rows) in enumerate(pages, 1):
            lines = (f'<row r="{r}">' + "".join(_cell(f"{column_name(c)}{r}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([head, *rows], 1))
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
