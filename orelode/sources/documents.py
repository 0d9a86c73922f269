"""Files of a folder tree as texts, with a manifest of what was taken, skipped and failed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE_CAP = 20 * 1024 * 1024
LEAST_TEXT = 100
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "file string, folder string, type string, source_file string, text string, text_size long, status string, reason string"


def clean_document(text: str) -> str:
    text = re.sub(r"[ \t\xa0]+", " ", text.replace("\0", ""))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def docx_text(data: bytes) -> str:
    """Paragraphs, then the rows of tables with `` | `` between cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t"))
    lines = [words(p) for p in body.findall(f"{WORD}p")]
    for row in body.iter(f"{WORD}tr"):
        lines.append(" | ".join(words(c).strip() for c in row.findall(f"{WORD}tc")))
    return "\n".join(x for x in lines if x.strip())


def pdf_text(data: bytes) -> str:
    """Text of the pages, an unreadable page left out; needs PyMuPDF, which is optional."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF reader is installed") from e
    pages = []
    with fitz.open(stream=data, filetype="pdf") as document:
        for page in document:
            try:
                pages.append(page.get_text())
            except Exception:
                continue
    return "\n".join(pages)


READERS = {"txt": lambda data: data.decode("utf-8", "ignore"), "docx": docx_text, "pdf": pdf_text}


def read_file(path: str, root: str, data: bytes | None, length: int) -> tuple:
    relative = path.split(root.rstrip("/") + "/", 1)[-1]
    folder, _, name = relative.rpartition("/")
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    base = (relative, folder, kind, relative.replace("/", "__") + ".txt")
    if kind not in READERS:
        return (*base, None, None, "skipped", "unsupported type")
    if length > SIZE_CAP or data is None:
        return (*base, None, None, "skipped", "too large")
    try:
        text = clean_document(READERS[kind](data))
    except Exception as e:
        return (*base, None, None, "error", f"{type(e).__name__}: {e}"[:200])
    if len(text) < LEAST_TEXT and kind == "pdf":
        return (*base, None, len(text), "skipped", "no text layer")
    return (*base, text, len(text), "ok", None)


def read_upload(name: str, data: bytes) -> tuple:
    """One uploaded file as a row of SCHEMA; its name is made safe, other types than those of READERS are skipped."""
    stem, _, kind = name.replace("\\", "/").rpartition("/")[2].rpartition(".")
    safe = re.sub(r"[^\w.-]|_", "_", stem)[:120] or "upload"
    return read_file(f"upload/{safe}.{kind.lower()}", "upload", data, len(data))


def scan_documents(spark: SparkSession, root: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """One row a file under root, in whose relative path one of ``folders`` stands (all if none are given).

    Columns as in SCHEMA; text is NULL unless status is ok. Files over the size cap are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    content = F.when(F.col("length") <= SIZE_CAP, F.col("content")).alias("content")
    if folders:
        files = files.where(F.expr(" OR ".join(f"contains(path, '{f}')" for f in (x.replace("'", "''") for x in folders))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
        for batch in batches:
            rows = [read_file(p, root, c, n) for p, c, n in zip(batch["path"], batch["content"], batch["length"])]
            frame = pd.DataFrame(rows, columns=names).astype(object)
            yield frame.where(frame.notna(), None)

    return files.select("path", content, "length").mapInPandas(run, SCHEMA)


def manifest(scanned: DataFrame) -> DataFrame:
    return scanned.select("file", "folder", "type", "text_size", "status", "reason")
