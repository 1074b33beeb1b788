"""Documents of formats other than tables: Office files through the standard library, PDF geometry, and injected extractors."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans as S

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
PARAGRAPHS = "path string, part string, paragraph int, text string"
CELLS = "path string, sheet string, row int, column int, letter string, header string, cell string"
#: What a hyperlink's target becomes where it is redacted.
REDACTED_LINK = "https://redacted.invalid/"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def docx_paragraphs(content: bytes) -> Iterator[tuple[str, int, str]]:
    """(part, index, text) of the paragraphs of body, headers, footers, notes and comments; of shapes and text boxes within them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", n)]
        for name in sorted(names, key=lambda n: (n != "word/document.xml", n)):
            for i, p in enumerate(ET.fromstring(z.read(name)).iter(f"{_W}p")):
                text = "".join("\t" if t.tag == f"{_W}tab" else t.text or "" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}delText", f"{_W}instrText"))
                yield name[5:-4], i, text


def docx_redacted(content: bytes, texts: dict[tuple[str, int], str]) -> bytes:
    """The file with new texts of paragraphs: a paragraph's first run gets the text, the others become empty."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in z.infolist():
            data = z.read(item.filename)
            part = item.filename[5:-4]
            if any(k[0] == part for k in texts):
                root = ET.fromstring(data)
                for i, p in enumerate(root.iter(f"{_W}p")):
                    if (part, i) in texts:
                        runs = [t for t in p.iter() if t.tag in (f"{_W}t", f"{_W}delText", f"{_W}instrText")]
                        for k, t in enumerate(runs):
                            t.text = texts[part, i] if k == 0 else ""
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            new.writestr(item, data)
    return out.getvalue()


def letter(index: int) -> str:
    """Letters of a column: 1 is A, 27 is AA."""
    out = ""
    while index > 0:
        index, r = divmod(index - 1, 26)
        out = chr(65 + r) + out
    return out


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of all cells with text, in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_X}si")]
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet")]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name, path in zip(names, sheets, strict=False):
            for c in ET.fromstring(z.read(path)).iter(f"{_X}c"):
                v, inline = c.find(f"{_X}v"), c.find(f"{_X}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_X}t")) if inline is not None else v.text if v is not None else None
                if text is not None:
                    ref = c.get("r")
                    yield name, int(re.search(r"\d+", ref)[0]), _column(ref), shared[int(text)] if c.get("t") == "s" else text


def paragraphs(docs: DataFrame) -> DataFrame:
    """files (path, content) of .docx to PARAGRAPHS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                found = list(docx_paragraphs(content))
                yield pd.DataFrame({"path": [path] * len(found), "part": [f[0] for f in found], "paragraph": [f[1] for f in found], "text": [f[2] for f in found]})

    return docs.select("path", "content").mapInPandas(run, PARAGRAPHS)


def cells(docs: DataFrame) -> DataFrame:
    """files (path, content) of .xlsx to CELLS; the first row of a sheet holds the headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                found = list(xlsx_cells(content))
                first = {}
                for s, r, c, t in found:
                    first.setdefault(s, r)
                heads = {(s, c): t for s, r, c, t in found if r == first[s]}
                out = [(path, s, r, c, letter(c), heads.get((s, c)) if r > first[s] else None, t) for s, r, c, t in found]
                yield pd.DataFrame(out, columns=["path", "sheet", "row", "column", "letter", "header", "cell"])

    return docs.select("path", "content").mapInPandas(run, CELLS)


def extracted(docs: DataFrame, extract: Callable[[bytes], list[tuple[int, str, list]]]) -> DataFrame:
    """files to (path, page, line, text, boxes) by an injected extractor: of PDF text, or of OCR."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                found = extract(content)
                yield pd.DataFrame({"path": [path] * len(found), "page": [f[0] for f in found], "line": range(len(found)), "text": [f[1] for f in found], "boxes": [f[2] for f in found]})

    return docs.select("path", "content").mapInPandas(run, "path string, page int, line int, text string, boxes array<struct<left:double,bottom:double,right:double,top:double>>")


def pages(lines: DataFrame) -> DataFrame:
    """Lines (path, page, line, text) joined to a text for each page, with the lines' places in it."""
    rows = lines.groupBy("path", "page").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line:int,s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        e = (acc["at"] + F.length(x["text"])).cast("int")
        return F.struct((e + 1).cast("int").alias("at"), F.array_append(acc["out"], F.struct(x["line"].alias("line"), acc["at"].alias("s"), e.alias("e"))).alias("out"))

    return rows.select("path", "page", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"), F.aggregate("l", zero, step, lambda a: a["out"]).alias("lines"))


def per_line(page: DataFrame) -> DataFrame:
    """Spans of pages (path, page, lines, spans) cut at the lines they cross: path, page, line, and the range within the line."""
    rows = page.select("path", "page", "lines", F.explode("spans").alias("span")).select("path", "page", "span", F.explode("lines").alias("l"))
    rows = rows.where((F.col("span.character_start") < F.col("l.e")) & (F.col("l.s") < F.col("span.character_end")))
    start, end = F.greatest(F.col("span.character_start"), F.col("l.s")) - F.col("l.s"), F.least(F.col("span.character_end"), F.col("l.e")) - F.col("l.s")
    return rows.select("path", "page", F.col("l.line").alias("line"), start.cast("int").alias("line_start"), end.cast("int").alias("line_end"), "span")


def padded_box(boxes: Column, start: Column, end: Column) -> Column:
    """The box around the characters of a range (null ones have no place), a quarter of its height and a point larger."""
    own = F.filter(F.slice(boxes, start + 1, end - start), lambda b: b.isNotNull())
    least, most = lambda k: F.array_min(F.transform(own, lambda b: b[k])), lambda k: F.array_max(F.transform(own, lambda b: b[k]))
    pad = (most("top") - least("bottom")) * 0.25 + 1
    return F.when(F.size(own) > 0, F.struct((least("left") - pad).alias("left"), (least("bottom") - pad).alias("bottom"), (most("right") + pad).alias("right"), (most("top") + pad).alias("top")))


def on_page(box_page: Column, page: Column) -> Column:
    """Whether a fixed box is on a page: 0 on all, n on the n-th, -n from the n-th on."""
    return (box_page == 0) | (box_page == page) | ((box_page < 0) & (page >= -box_page))


def redact_docx(docs: DataFrame, redactor) -> DataFrame:
    """files of .docx to (path, content, spans): paragraphs are searched as rows, each file is written by the task that holds it."""
    found = redactor.redact(paragraphs(docs), "text")
    changed = found.where("size(spans) > 0").groupBy("path").agg(F.collect_list(F.struct("part", "paragraph", "filtered_text")).alias("texts"), F.sum(F.size("spans")).cast("int").alias("spans"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            new = [c if t is None else docx_redacted(c, {(x["part"], x["paragraph"]): x["filtered_text"] for x in t}) for c, t in zip(rows["content"], rows["texts"], strict=True)]
            yield rows[["path"]].assign(content=new, spans=rows["spans"].fillna(0).astype(int))

    return docs.select("path", "content").join(changed, "path", "left").mapInPandas(run, "path string, content binary, spans int")


def in_paragraphs(texts: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of paragraphs or cells with saved spans (keys, character_start, character_end, replacement) put in again."""
    own = saved.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("character_start", "character_end", "replacement"))).alias("s"))
    whole = F.transform("s", lambda x: F.struct(*[(x[f] if f in ("character_start", "character_end", "replacement") else F.lit(None)).alias(f) for f in ("character_start", "character_end", "replacement")]))
    return texts.join(own, keys, "left").withColumn("filtered_text", F.when(F.col("s").isNull(), F.col("text")).otherwise(S.replaced(F.col("text"), whole))).drop("s")
