"""PDF text: one row a page, by an extractor that is injected or imported when first used."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.shipping import shipped

#: bytes of a file -> (texts of its pages, raw metadata)
Extractor = Callable[[bytes], tuple[list[str | None], dict[str, str]]]

METADATA = ("title", "author", "subject", "keywords", "creator", "producer", "creation_date", "modification_date")
PAGES = "path string, page_number int, page_count int, text string, metadata map<string,string>, error string, error_kind string"


#: characters and rows of pages that are handed on at once
CHARACTERS_AT_ONCE, PAGES_AT_ONCE = 2**22, 1024


class EncryptedError(ValueError):
    """The empty password does not open the file."""


class MalformedError(ValueError):
    """The file is no readable PDF."""


def _kind(problem: Exception) -> str:
    return "encrypted" if isinstance(problem, EncryptedError) else "malformed" if isinstance(problem, MalformedError) else "parser"


def extract_with_pypdf(content: bytes) -> tuple[list[str | None], dict[str, str]]:
    """Page texts by the ``pypdf`` package; an encrypted file is tried with the empty password only."""
    import pypdf

    #: fixed values: the keys of a document's information dictionary
    keys = ("/Title", "/Author", "/Subject", "/Keywords", "/Creator", "/Producer", "/CreationDate", "/ModDate")
    try:
        reader = pypdf.PdfReader(io.BytesIO(content), strict=True)
        if reader.is_encrypted and not reader.decrypt(""):
            raise EncryptedError("a password is needed")
        raw = reader.metadata or {}
        return [page.extract_text() for page in reader.pages], {name: str(raw[key]) for name, key in zip(METADATA, keys, strict=True) if raw.get(key) is not None}
    except (pypdf.errors.FileNotDecryptedError, pypdf.errors.WrongPasswordError) as problem:
        raise EncryptedError(str(problem)) from problem
    except pypdf.errors.PdfReadError as problem:
        raise MalformedError(str(problem)) from problem


def pages_of(files: DataFrame, extractor: Extractor = extract_with_pypdf) -> DataFrame:
    """The pages of files (path, content). A file that fails gives one row with its error, the error's kind (encrypted, malformed, parser) and no page."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in PAGES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows: list[tuple] = []
                try:
                    texts, metadata = extractor(content.as_py() or b"")
                    clean = [(t or "").replace("\r\n", "\n").replace("\r", "\n") for t in texts]
                    rows = [(path.as_py(), n, len(clean), t, list(metadata.items()), None, None) for n, t in enumerate(clean, 1)] or [(path.as_py(), None, 0, None, list(metadata.items()), None, None)]
                except Exception as problem:  # one file never ends the batch
                    rows = [(path.as_py(), None, None, None, None, f"{type(problem).__name__}: {problem}", _kind(problem))]
                held += rows
                size += sum(len(r[3] or "") for r in rows)
                if size >= CHARACTERS_AT_ONCE or len(held) >= PAGES_AT_ONCE:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return shipped(files).select("path", "content").mapInArrow(run, PAGES)


def read_pdfs(spark: SparkSession, path: str, extractor: Extractor = extract_with_pypdf) -> DataFrame:
    """The pages of all PDF files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return pages_of(files, extractor)


def title_or_stem(title: object, path: object) -> object:
    """The trimmed title, else the file's name without its extension."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""))
