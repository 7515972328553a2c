"""PDF pages written and read: layouts, line breaking, foreign forms of the format, broken files."""

import random
import re
import zlib

from clauseloom.sources import docx, pdf

TEXT = "EXHIBIT A\n\nAGREEMENT OF SALE AND PURCHASE\n\nThe parties (the \\ \"Seller\") agree; é ü ñ €.\n\n" + "A long paragraph of words that fills some lines. " * 40


def test_both_layouts_read_back(spark, tmp_path):
    docs = spark.createDataFrame([("a_deed.pdf", TEXT), ("empty.pdf", ""), ("null.pdf", None), ("long.pdf", "\n\n".join(f"paragraph {k}" for k in range(300)))], "name string, text string")
    for layout in pdf.LAYOUTS:
        where = str(tmp_path / layout)
        files = pdf.pdf_files(docs, layout)
        docx.write_files(files, where)
        (tmp_path / layout / "broken.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Length 5 /Filter /FlateDecode >>\nstream\nxxxxx\nendstream endobj")
        (tmp_path / layout / "other.pdf").write_bytes(b"no pdf at all")
        read = spark.read.format("binaryFile").load(where).select("path", "content")
        rows = pdf.pdf_pages(read).collect()
        text = {}
        for r in sorted((r for r in rows if r.error is None), key=lambda r: r.page_no):
            text.setdefault(r.path.rsplit("/", 1)[1], []).append(r.text)
        assert {r.path.rsplit("/", 1)[1] for r in rows if r.error} == {"broken.pdf", "other.pdf"}
        words = " ".join(text["a_deed.pdf"]).split()
        title = ["a", "deed.pdf"] if layout == "simple" else []
        assert words == [*title, *TEXT.replace("€", "?").split()]
        assert text["empty.pdf"] == (["empty.pdf"] if layout == "simple" else [""])
        numbers = [int(x) for x in re.findall(r"paragraph (\d+)", " ".join(text["long.pdf"]))]
        assert numbers == list(range(50 if layout == "simple" else 300)) and len(text["long.pdf"]) > (0 if layout == "simple" else 3)
        made = {r.path: r.text for r in docx.docx_nodes(pdf.pdf_to_docx(read).withColumnRenamed("name", "path")).collect()}
        assert set(made) == {"a_deed.docx", "empty.docx", "null.docx", "long.docx"} and made["a_deed.docx"].split() == words


def test_lines_are_full_and_fit():
    r = random.Random(1)
    for layout in pdf.LAYOUTS.values():
        for bold in (False, True):
            words = ["".join(r.choice("abcWMil.,é") for _ in range(r.randint(1, 12))) for _ in range(300)]
            lines = pdf.broken(words, layout, layout.size, bold, 200)
            assert " ".join(lines).split() == words
            wide = lambda t: pdf.width_of(t, layout, layout.size, bold)  # noqa: B023,E731
            assert all(wide(t) <= 200.001 for t in lines if " " in t)
            assert all(wide(a + " " + b.split()[0]) > 200 for a, b in zip(lines, lines[1:], strict=False))
    assert pdf.broken(["W" * 100], pdf.SIMPLE, 10, False, 50) == ["W" * 100]


def test_foreign_forms():
    """Arrays with kerning, hexadecimal strings, escapes, moves by T*, Tm and quotes; pages in a tree; object streams; no table of places."""
    content = rb"BT 12 TL 1 0 0 1 50 700 Tm [(Ker) -20 (ned) -300 (text)] TJ T* <48656C6C6F> Tj (\(\101\)\n) ' 0 -14 TD (nested (a) b) Tj ET BT /F1 9 Tf 50 600 Td (\\ end) Tj ET"
    packed = zlib.compress(content)
    inner = b"4 0 5 42 << /Type /Page /Parent 2 0 R /Contents [7 0 R] >>    << /Type /Pages /Parent 2 0 R /Kids [4 0 R] >>"
    first = inner.index(b"<<")
    numbers = b"4 0 5 %d " % (inner.index(b"<< /Type /Pages") - first)
    body = numbers + inner[first:]
    raw = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [5 0 R 3 0 R] /Count 2 >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Contents 8 0 R >> endobj\n"
    raw += b"6 0 obj << /Type /ObjStm /N 2 /First %d /Length %d >>\r\nstream\r\n%s\nendstream endobj\n" % (len(numbers), len(body), body)
    raw += b"7 0 obj << /Filter /FlateDecode /Length 9 0 R >> stream\n%s\nendstream endobj\n9 0 obj %d endobj\n8 0 obj << /Length 28 >> stream\nBT 9 9 Td (second page) Tj ET\nendstream endobj" % (packed, len(packed))
    assert pdf.pages_of(raw) == ["Kerned text\nHello\n(A)\n\nnested (a) b\n\\ end", "second page"]
