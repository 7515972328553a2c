"""Texts as PDF pages in two layouts, and the text of PDF pages: small helpers by row, run by Spark over tables of files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.batches import pieces
from clauseloom.sources import docx

# Advance widths of the printable ASCII signs, in thousandths of the font's size.
HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
TIMES = [250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, *[500] * 10, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541]
#: A letter page, and how much wider bold letters are taken to be.
WIDTH, HEIGHT, BOLDER = 612, 792, 1.06
#: What no single-byte font has a sign for; it is written as a question mark.
UNFIT = re.compile(r"[^\x20-\x7e\xa0-\xff]")


@dataclass(frozen=True)
class Layout:
    fonts: tuple[str, str]
    widths: tuple[int, ...]
    size: float
    leading: float
    margin: float
    indent: float
    after: float
    #: The most paragraphs that are set, and whether a title stands above; headings are set right (exhibits) or centred.
    most: int | None = None
    title_size: float | None = None
    headings: bool = False


SIMPLE = Layout(("Helvetica", "Helvetica-Bold"), tuple(HELVETICA), 10, 12, 72, 0, 7.2, most=50, title_size=18)
CONTRACT = Layout(("Times-Roman", "Times-Bold"), tuple(TIMES), 9, 11, 72, 18, 6, headings=True)
LAYOUTS = {"simple": SIMPLE, "contract": CONTRACT}


class Units(dict):
    """A word's width in thousandths, counted once; a bounded number of words is kept."""

    def __init__(self, widths: tuple[int, ...]) -> None:
        self.widths = {chr(k): w for k, w in enumerate(widths[:95], 32)}

    def __missing__(self, text: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        own = self[text] = sum(self.widths.get(c, 500) for c in text)
        return own


#: The words' widths of a layout in a Python worker.
_units: dict[tuple[int, ...], Units] = {}


def units_of(layout: Layout) -> Units:
    return _units.get(layout.widths) or _units.setdefault(layout.widths, Units(layout.widths))


def width_of(text: str, layout: Layout, size: float, bold: bool, units: Units | None = None) -> float:
    own = (units_of(layout) if units is None else units)[text] * size / 1000
    return own * BOLDER if bold else own


def broken(words: list[str], layout: Layout, size: float, bold: bool, room: float) -> list[str]:
    """Lines of words, each as full as the room allows; a wider word has a line of its own."""
    lines, now, used = [], [], 0.0
    units = units_of(layout)
    blank = width_of(" ", layout, size, bold, units)
    for w in words:
        n = width_of(w, layout, size, bold, units)
        if now and used + blank + n > room:
            lines.append(" ".join(now))
            now, used = [], 0.0
        used += (blank if now else 0) + n
        now.append(w)
    return [*lines, " ".join(now)] if now else lines


def set_lines(text: str, title: str, layout: Layout) -> list[tuple[str, bool, float, float, float]]:
    """(line, bold, size, x, space above) of a text's paragraphs, which blank lines part."""
    out, room = [], WIDTH - 2 * layout.margin

    def put(part: str, bold: bool, size: float, side: str, above: float) -> None:
        indent = layout.indent if side == "left" else 0
        for k, line in enumerate(broken(UNFIT.sub("?", " ".join(part.split())).split(), layout, size, bold, room - indent)):
            free = 0 if side == "left" else room - width_of(line, layout, size, bold)
            x = layout.margin + {"left": indent, "right": max(0, free), "centre": max(0, free / 2)}[side]
            out.append((line, bold, size, x, above if k == 0 else 0))

    if layout.title_size:
        put(title, True, layout.title_size, "centre", 0)
    for part in [p for p in re.split(r"\n\n", text) if p.strip()][: layout.most]:
        if layout.headings and "EXHIBIT" in part and len(part) < 50:
            put(part, True, layout.size, "right", 2 * layout.after)
        elif layout.headings and "AGREEMENT" in part and part.isupper() and len(part) < 100:
            put(part, True, layout.size, "centre", 2 * layout.after)
        else:
            put(part, False, layout.size, "left", layout.after)
    return out


def string(text: str) -> bytes:
    return b"(" + re.sub(rb"([\\()])", rb"\\\1", text.encode("latin-1")) + b")"


def pdf_bytes(text: str, title: str = "", layout: Layout = SIMPLE) -> bytes:
    """A PDF of the text; equal texts are equal bytes."""
    pages, now, y = [], [], HEIGHT - layout.margin
    for line, bold, size, x, above in set_lines(text, title, layout):
        step = max(layout.leading, size * 1.2) + (above if now else 0)
        if now and y - step < layout.margin:
            pages.append(now)
            now, y = [], HEIGHT - layout.margin
        y -= step
        now.append(b"BT /F%d %.4g Tf %.6g %.6g Td %s Tj ET" % (1 + bold, size, x, y, string(line)))
    pages.append(now)
    kids = b" ".join(b"%d 0 R" % (5 + 2 * k) for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, len(pages))]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % f.encode() for f in layout.fonts]
    for k, page in enumerate(pages):
        stream = zlib.compress(b"\n".join(page))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, 6 + 2 * k))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, places = [b"%PDF-1.4\n"], []
    at = len(out[0])
    for n, body in enumerate(objects, 1):
        places.append(at)
        out.append(b"%d 0 obj\n%s\nendobj\n" % (n, body))
        at += len(out[-1])
    out.append(b"xref\n0 %d\n0000000000 65535 f \n%s" % (len(objects) + 1, b"".join(b"%010d 00000 n \n" % p for p in places)))
    out.append(b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))
    return b"".join(out)


OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
REF = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:[^\\()]|\\.|\((?:[^\\()]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/[^\s\[\]()<>/]+|[A-Za-z'\"*]+", re.DOTALL)
# Escapes in strings.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def objects_of(raw: bytes) -> dict[int, tuple[bytes, bytes]]:
    """Number -> (dictionary, stream, inflated) of all objects, also those in object streams; found by their marks, so a bad table of places does no harm."""
    out: dict[int, tuple[bytes, bytes]] = {}
    for m in OBJECT.finditer(raw):
        end = raw.find(b"endobj", m.end())
        body = raw[m.end() : end if end >= 0 else len(raw)]
        head, mark, rest = body.partition(b"stream")
        if mark:
            start = m.end() + len(head) + len(mark)
            start += 2 if raw[start : start + 2] == b"\r\n" else 1
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            stop = start + int(length[1]) if length else raw.find(b"endstream", start)
            data = raw[start:stop]
            if b"/FlateDecode" in head:
                data = zlib.decompressobj().decompress(data)
            out[int(m[1])] = (head, data)
        else:
            out[int(m[1])] = (body, b"")
    for head, data in list(out.values()):
        if b"/ObjStm" in head:
            first, n = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"First", b"N"))
            numbers = list(map(int, data[:first].split()))[: 2 * n]
            places = numbers[1::2]
            for number, a, b in zip(numbers[::2], places, [*places[1:], len(data) - first], strict=True):
                out.setdefault(number, (data[first + a : first + b], b""))
    return out


def page_order(objects: dict[int, tuple[bytes, bytes]]) -> list[int]:
    """Numbers of pages in the order of the tree; in that of their numbers if there is no tree."""
    is_page = lambda n: re.search(rb"/Type\s*/Page(?![A-Za-z])", objects[n][0])
    tops = [n for n, (head, _) in objects.items() if re.search(rb"/Type\s*/Pages", head) and b"/Parent" not in head]
    todo, out, seen = tops[:1], [], set()
    while todo:
        n = todo.pop()
        if n in objects and n not in seen:
            seen.add(n)
            if is_page(n):
                out.append(n)
            elif kids := re.search(rb"/Kids\s*\[([^\]]*)\]", objects[n][0]):
                todo += [int(k) for k in REF.findall(kids[1])][::-1]
    return out or sorted(n for n in objects if is_page(n))


def decoded(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")

    def back(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else ESCAPES.get(c, b"" if c in (b"\n", b"\r") else c)

    return re.sub(rb"\\([0-7]{1,3}|.)", back, token[1:-1], flags=re.DOTALL).decode("latin-1")


def shown_text(content: bytes) -> str:
    """What a page's operators show, a line for each new height; wide steps in arrays are blanks."""
    lines, y, last, operands, parts = [], 0.0, None, [], []

    def show(text: str) -> None:
        nonlocal last
        if last is not None and abs(y - last) > 1e-3:
            lines.append("".join(parts))
            parts.clear()
        parts.append(text)
        last = y

    leading, inside = 0.0, None
    for m in TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            inside = []
        elif t == b"]":
            operands.append(inside or [])
            inside = None
        elif t[:1] in b"(<":
            (inside if inside is not None else operands).append(decoded(t))
        elif t[:1] in b"-+.0123456789":
            (inside if inside is not None else operands).append(float(t))
        elif t[:1] == b"/":
            operands.append(t)
        else:
            numbers = [x for x in operands if isinstance(x, float)]
            if t == b"BT":
                y = 0.0
            elif t in (b"Td", b"TD") and len(numbers) >= 2:
                y += numbers[-1]
                leading = -numbers[-1] if t == b"TD" else leading
            elif t == b"TL" and numbers:
                leading = numbers[-1]
            elif t == b"Tm" and len(numbers) >= 6:
                y = numbers[-1]
            elif t == b"T*":
                y -= leading
            elif t in (b"Tj", b"'", b'"') and operands and isinstance(operands[-1], str):
                y -= leading if t != b"Tj" else 0
                show(operands[-1])
            elif t == b"TJ" and operands and isinstance(operands[-1], list):
                show("".join(x if isinstance(x, str) else " " if x < -200 else "" for x in operands[-1]))
            operands = []
    return "\n".join([*lines, "".join(parts)] if parts else lines)


def pages_of(raw: bytes) -> list[str]:
    if not raw.lstrip()[:5].startswith(b"%PDF"):
        raise ValueError("no PDF")
    objects = objects_of(raw)
    order = page_order(objects)
    if not order:
        raise ValueError("no pages")
    out = []
    for n in order:
        of = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", objects[n][0])
        out.append(shown_text(b"\n".join(objects[int(k)][1] for k in REF.findall(of[1]) if int(k) in objects)) if of else "")
    return out


def pdf_files(docs: DataFrame, layout: str = "simple") -> DataFrame:
    """(name, content): a PDF for each row of docs (name, text). Letters that single-byte fonts lack become `?`."""
    own = LAYOUTS[layout]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [pdf_bytes(t or "", (n or "").replace("_", " "), own) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["name", "content"])

    return docs.select("name", "text").mapInArrow(run, "name string, content binary")


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, page_no, text, error) of files (path, content); a file that can't be read is one row with its error.

    Text in single-byte fonts is read; encrypted files and fonts with encodings of their own are not decoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(path, k, t, None) for k, t in enumerate(pages_of(raw or b""), 1)]
                except (ValueError, KeyError, TypeError, IndexError, zlib.error) as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["path", "page_no", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_no int, text string, error string")


def pdf_to_docx(files: DataFrame) -> DataFrame:
    """(name, content): a DOCX for each PDF of files (path, content), a paragraph for each line of its pages; unreadable files are left out."""
    lines = pdf_pages(files).filter("error is null").select(F.element_at(F.split("path", "/"), -1).alias("file"), "page_no", F.posexplode_outer(F.split("text", "\n")).alias("k", "text"))
    none = F.lit(None).cast("string")
    # Numbers of paragraphs need only rise: pages have far fewer lines than a million.
    rows = lines.select(F.regexp_replace("file", r"(?i)\.pdf$", ".docx").alias("name"), (F.col("page_no").cast("bigint") * 1_000_000 + F.col("k")).alias("para_no"), F.lit(1).alias("seq"), F.lit(docx.KEPT).alias("kind"), "text", none.alias("author"), none.alias("made_at"))
    return docx.docx_files(rows)
