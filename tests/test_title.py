import sys
import types

from foliograph.operators import layout
from foliograph.sources import files
from tests.test_layout import block


def test_title_page_and_sections(spark):
    names = ("doc", "page", "block_no", "type", "bbox", "lines")
    rows = []
    for doc, lines in (("a", ["3500B Engines", "S2D 1-UP (3516B)", "S2E 1-UP (3508B)"]), ("b", ["C18 Marine", "CYG 1-UP (Engine)", "SEBU C32"])):
        rows += [dict(zip(names, block(i, 60, 200 + 20 * i, 300, x))) | {"doc": doc} for i, x in enumerate(lines)]
    rows.append(dict(zip(names, block(9, 60, 20, 300, "14 Maintenance Section"))) | {"doc": "a", "page": 2})
    blocks = spark.createDataFrame(rows, layout.BLOCKS)
    got = {x.doc: (x.serial_prefixes, x.applicable_models) for x in layout.title_pages(blocks).collect()}
    assert got == {"a": (["S2D", "S2E"], ["3508B", "3516B"]), "b": (["CYG"], ["C18"])}
    assert [tuple(x) for x in layout.page_sections(blocks).collect()] == [("a", 2, "Maintenance Section")]


def test_drawings_of_a_pdf(monkeypatch):
    class Doc(list):
        __enter__ = lambda self: self
        __exit__ = lambda self, *x: None

    page = types.SimpleNamespace(get_drawings=lambda: [{"type": "f", "rect": (1, 2, 3, 4)}])
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda path: Doc([page, page])))
    reader = files.PdfDrawings({"path": "x"}).reader(None)
    assert list(reader.read(files.InputPartition("/m/x.pdf"))) == [("x.pdf", n, 0, "f", 1.0, 2.0, 3.0, 4.0) for n in (1, 2)]
