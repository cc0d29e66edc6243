"""PDF documents as rows of pages: text, words in blocks, tables, images and whether OCR is needed.

A small reader for the documents of quotations: objects and object streams, page trees, content
streams (plain or Flate), text operators with their positions, and image objects. Errors stay on
their page. A file without pages has one row, with page 0 and the error. Fonts' own encodings aren't
read: bytes are Latin-1, or UTF-16 where they say so.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.operators.documents import OCR_TEXT
from quotemill.session import ship

SCHEMA = "document_id string, page_number int, page_count int, width double, height double, text string, blocks array<string>, tables array<array<array<string>>>, images int, requires_ocr boolean, errors array<string>"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _objects(raw: bytes) -> dict[int, bytes]:
    found = {int(n): body for n, body in _OBJECT.findall(raw)}
    for body in list(found.values()):
        if b"/ObjStm" in body[:400]:
            data, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = list(map(int, data[:first].split()))
            ends = [*heads[3::2], len(data) - first]
            for n, at, end in zip(heads[::2], heads[1::2], ends, strict=False):
                found.setdefault(n, data[first + at : first + end])
    return found


def _stream(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    return zlib.decompressobj().decompress(found[1]) if b"FlateDecode" in body[: found.start()] else found[1]


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPE.get(m[1], m[1]), token[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _placed(content: bytes) -> list[tuple[float, float, str]]:
    """(y, x, text) of what a content stream shows."""
    out, stack, x, y, left, lead, array = [], [], 0.0, 0.0, 0.0, 12.0, None
    for token in _TOKEN.findall(content):
        head = token[:1]
        if head in b"(<":
            (stack if array is None else array).append(_string(token))
        elif head == b"[":
            array = []
        elif head == b"]":
            stack, array = [*stack, array or []], None
        elif re.fullmatch(rb"[-+]?(\d+\.?\d*|\.\d+)", token):
            (stack if array is None else array).append(float(token))
        else:
            n = [v for v in stack if isinstance(v, float)]
            if token == b"BT":
                x = y = left = 0.0
            elif token in (b"Td", b"TD") and len(n) >= 2:
                left, y = left + n[-2], y + n[-1]
                x, lead = left, -n[-1] if token == b"TD" else lead
            elif token == b"Tm" and len(n) >= 6:
                x, y = n[-2], n[-1]
                left = x
            elif token == b"TL" and n:
                lead = n[-1]
            elif token in (b"T*", b"'", b'"'):
                x, y = left, y - lead
            if token in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], str):
                out.append((y, x, stack[-1]))
                x += 5.0 * len(stack[-1])
            elif token == b"TJ" and stack and isinstance(stack[-1], list):
                # A wide step back between parts is a blank.
                text = "".join(v if isinstance(v, str) else " " if v < -200 else "" for v in stack[-1])
                out.append((y, x, text))
                x += 5.0 * len(text)
            if head != b"/":
                stack = []
    return out


def _page(content: bytes) -> tuple[str, list[str], list[list[list[str]]]]:
    """Text by lines from the top, its words, and the tables: runs of lines that have the same number of cells, two or more."""
    lines: dict[int, list[tuple[float, str]]] = {}
    for y, x, t in _placed(content):
        lines.setdefault(round(y / 3), []).append((x, t))
    rows = [[t.strip() for _, t in sorted(lines[y], key=lambda c: c[0]) if t.strip()] for y in sorted(lines, reverse=True)]
    rows = [r for r in rows if r]
    text = "\n".join(" ".join(r) for r in rows).strip()
    tables: list[list[list[str]]] = []
    run: list[list[str]] = []
    for r in [*rows, []]:
        if len(r) >= 2 and (not run or len(run[0]) == len(r)):
            run.append(r)
            continue
        if len(run) >= 2:
            tables.append(run)
        run = [r] if len(r) >= 2 else []
    return text, text.split(), tables


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """The page objects in the order of the tree; by number where there is no tree."""
    kind = lambda b: re.search(rb"/Type\s*/(\w+)", b)
    of = {n: (k := kind(b)) and k[1] for n, b in objects.items()}
    root = next((n for n, b in objects.items() if of[n] == b"Pages" and b"/Parent" not in b), None)
    order: list[int] = []

    def walk(n: int, depth: int = 0) -> None:
        if n not in objects or depth > 50:
            return
        if of.get(n) == b"Page":
            order.append(n)
        elif (kids := re.search(rb"/Kids\s*\[(.*?)\]", objects[n], re.S)) is not None:
            for k in _REF.findall(kids[1]):
                walk(int(k), depth + 1)

    if root is not None:
        walk(root)
    return [objects[n] for n in order or sorted(n for n in objects if of[n] == b"Page")]


def read_pdf(raw: bytes | None) -> list[tuple]:
    """(page_number, page_count, width, height, text, blocks, tables, images, requires_ocr, errors) of each page."""
    raw = raw or b""
    if not raw.lstrip()[:5].startswith(b"%PDF"):
        return [(0, 0, 0.0, 0.0, "", [], [], 0, False, ["not a PDF"])]
    try:
        objects = _objects(raw)
        pages = _pages(objects)
    except Exception as e:
        return [(0, 0, 0.0, 0.0, "", [], [], 0, False, [f"objects: {e}"])]
    out = []
    for i, page in enumerate(pages):
        box = re.search(rb"/MediaBox\s*\[\s*([-.\d]+)\s+([-.\d]+)\s+([-.\d]+)\s+([-.\d]+)", page)
        width, height = (float(box[3]) - float(box[1]), float(box[4]) - float(box[2])) if box else (0.0, 0.0)
        resources = page
        if (r := re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page)) is not None:
            resources += objects.get(int(r[1]), b"")
        images = sum(bool(re.search(rb"/Subtype\s*/Image", objects.get(int(n), b""))) for n in _REF.findall(resources))
        try:
            named = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
            text, blocks, tables = _page(b"\n".join(_stream(objects.get(int(n), b"")) for n in _REF.findall(named[1])) if named else b"")
            out.append((i + 1, len(pages), width, height, text, blocks, tables, images, images > 0 and len(text) < OCR_TEXT, []))
        except Exception as e:
            out.append((i + 1, len(pages), width, height, "", [], [], images, True, [f"page {i + 1}: {e}"]))
    return out or [(0, 0, 0.0, 0.0, "", [], [], 0, False, ["no pages"])]


def _run(batches):
    for b in batches:
        rows = [(d, *row) for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for row in read_pdf(raw)]
        if rows:
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.list_(pa.string()))), pa.int32(), pa.bool_(), pa.list_(pa.string())]
            names = [x.split()[0] for x in SCHEMA.replace("array<array<array<string>>>", "t").split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pdf_pages(documents: DataFrame) -> DataFrame:
    """The pages of PDF documents (document_id, content)."""
    ship(documents.sparkSession)
    return documents.select(F.col("document_id").cast("string").alias("document_id"), "content").mapInArrow(_run, SCHEMA)


def pdf_documents(pages: DataFrame) -> DataFrame:
    """Documents of pages: the text of all, each under its number, and what the pages have."""
    shown = F.when(F.col("text") != "", F.struct("page_number", F.concat(F.lit("[Página "), F.col("page_number").cast("string"), F.lit("]\n"), F.col("text")).alias("t")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]), "\n\n")
    return pages.groupBy("document_id").agg(F.max("page_count").alias("page_count"), whole.alias("full_text"), F.sum("images").alias("images"), F.sum(F.size("tables")).alias("tables"), F.max("requires_ocr").alias("ocr_required"), F.flatten(F.collect_list("errors")).alias("errors"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """The pages of the PDF files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return pdf_pages(files.select(F.col("path").alias("document_id"), "content"))
