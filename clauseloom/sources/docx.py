"""DOCX files with tracked changes, from rows and back to rows, and a sink for rows that are files."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from clauseloom.functions.batches import pieces

NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
W = f"{{{NAMESPACE}}}"
KEPT, INSERTED, DELETED = "kept", "inserted", "deleted"
# The package parts that every document has.
TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: What XML cannot hold.
UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def document_xml(rows: list[dict]) -> str:
    """The main part of a document: rows (para_no, kind, text, author, made_at) in order; revisions are numbered from 1."""
    out, revision, para = [], 0, None
    for r in rows:
        if r["para_no"] != para:
            out += ["</w:p>"] * (para is not None) + ["<w:p>"]
            para = r["para_no"]
        text = escape(UNFIT.sub("", r["text"] or ""))
        if r["kind"] == KEPT:
            out.append(f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>')
            continue
        revision += 1
        tag, inner = ("ins", "t") if r["kind"] == INSERTED else ("del", "delText")
        about = f"w:id={quoteattr(str(revision))} w:author={quoteattr(UNFIT.sub('', r['author'] or ''))} w:date={quoteattr(UNFIT.sub('', r['made_at'] or ''))}"
        out.append(f'<w:{tag} {about}><w:r><w:{inner} xml:space="preserve">{text}</w:{inner}></w:r></w:{tag}>')
    out += ["</w:p>"] * (para is not None)
    return f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NAMESPACE}"><w:body>{"".join(out)}</w:body></w:document>'


def packed(main: str) -> bytes:
    """A DOCX package; equal documents are equal bytes."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELATIONS), ("word/document.xml", main)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), part.encode("utf-8"), zipfile.ZIP_DEFLATED)
    return raw.getvalue()


def docx_files(revisions: DataFrame) -> DataFrame:
    """(name, content): one DOCX for each name of revisions (name, para_no, seq, kind, text, author, made_at).

    kind is kept, inserted or deleted; null names make no file. The rows of one document meet in one task, as they become one file.
    """
    rows = F.array_sort(F.collect_list(F.struct("para_no", "seq", "kind", "text", "author", "made_at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [packed(document_xml(r)) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["name", "content"])

    return revisions.filter("name is not null").groupBy("name").agg(rows.alias("rows")).mapInArrow(run, "name string, content binary")


def revisions_of(content: bytes) -> list[tuple]:
    """(para_no, seq, kind, text, revision, author, made_at) of each run, from 1."""
    root, out = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")), []
    for para_no, para in enumerate(root.iter(f"{W}p"), 1):
        seq = 0
        for node in para:
            kind = {f"{W}r": KEPT, f"{W}ins": INSERTED, f"{W}del": DELETED}.get(node.tag)
            for run in [node] if kind == KEPT else node.iter(f"{W}r") if kind else []:
                text = "".join(t.text or "" for t in run if t.tag in (f"{W}t", f"{W}delText"))
                seq += 1
                out.append((para_no, seq, kind, text, int(node.get(f"{W}id")) if kind != KEPT else None, node.get(f"{W}author"), node.get(f"{W}date")))
    return out


def below(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every DOCX below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")


def _read(files: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows of each DOCX of files (path, content); one that can't be read is one row with its error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for p, content in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                try:
                    rows += [(p, *r, None) for r in rows_of(content)]
                except (zipfile.BadZipFile, KeyError, ValueError, TypeError, ElementTree.ParseError) as e:
                    rows.append((p, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, (list(c) for c in zip(*rows, strict=True)), strict=True)), schema=arrow)

    arrow = pa.schema([(n, {"int": pa.int32(), "string": pa.string()}[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)])
    return files.select("path", "content").mapInArrow(run, schema)


def docx_revisions(files: DataFrame) -> DataFrame:
    """(path, para_no, seq, kind, text, revision, author, made_at, error) of every run of files (path, content)."""
    return _read(files, "path string, para_no int, seq int, kind string, text string, revision int, author string, made_at string, error string", revisions_of)


def docx_nodes(files: DataFrame) -> DataFrame:
    """(path, text, error) of files (path, content): all text nodes of a file, joined by a blank, whatever paragraph they are in."""

    def nodes(content: bytes) -> list[tuple]:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
        return [(" ".join(t.text for t in root.iter(f"{W}t") if t.text),)]

    return _read(files, "path string, text string, error string", nodes)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class FileWriter(DataSourceWriter):
    """Each task writes its files under names of its own and says which; they get their names when all tasks are done."""

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://").removeprefix("file:")

    def write(self, iterator) -> Written:
        done = []
        os.makedirs(self.path, exist_ok=True)
        for row in iterator:
            if row["name"] is None or "/" in row["name"] or row["name"] in (".", ".."):
                raise ValueError(f"no file name: {row['name']!r}")
            part = f"{self.path}/.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(row["content"] or b"")
            done.append((part, f"{self.path}/{row['name']}"))
        return Written(done)

    def commit(self, messages: list) -> None:
        for part, name in (x for m in messages if m for x in m.files):
            os.replace(part, name)

    def abort(self, messages: list) -> None:
        for part, _ in (x for m in messages if m for x in m.files):
            if os.path.exists(part):
                os.remove(part)


class NamedFiles(DataSource):
    """Sink `named_files`: rows (name, content) become files in a folder that driver and executors have mounted; equal names are replaced."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """files (name, content) into a folder."""
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").mode("append").save(path)
