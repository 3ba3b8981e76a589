"""Members of tar and zip archives as rows, unsafe archives told apart before any content is read.

Nothing is unpacked to a disk: names are judged, links are resolved to the
content of the file they lead to, and the content travels as a column. One
unsafe member makes its whole archive unsafe.
"""

from __future__ import annotations

import io
import posixpath
import re
import stat
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quirelake.shipping import shipped

MEMBERS = "archive string, member string, size long, content binary, problem string"

#: fixed values: what a file name on Windows must not be or hold
_RESERVED = re.compile(r"(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?", re.I)
_FORBIDDEN = re.compile(r'[<>:"|?*\x00-\x1f]')


class Unsafe(ValueError):
    """Why an archive is not to be unpacked."""


def place(name: str) -> str:
    """A member's relative path with single slashes; an error if it leads, or might lead on some system, out of the folder or onto another name."""
    plain = name.replace("\\", "/")
    if plain.startswith("/") or re.match(r"[A-Za-z]:", plain):
        raise Unsafe(f"absolute: {name}")
    parts = [p for p in plain.split("/") if p not in ("", ".")]
    for part in parts:
        if part == "..":
            raise Unsafe(f"traversal: {name}")
        if _FORBIDDEN.search(part) or part[-1] in ". " or _RESERVED.fullmatch(part):
            raise Unsafe(f"name: {name}")
    if not parts:
        raise Unsafe(f"empty: {name}")
    return "/".join(parts)


def _checked(names: list[tuple[str, bool]]) -> list[str]:
    """The places of all members (name, whether a folder); no two may meet in any letter case, nor lie below a file."""
    places = [place(n) for n, _ in names]
    files = {p.casefold() for p, (_, folder) in zip(places, names, strict=True) if not folder}
    seen: set[str] = set()
    for p in places:
        key = p.casefold()
        if key in seen:
            raise Unsafe(f"duplicate: {p}")
        seen.add(key)
        while "/" in key:
            key = key.rpartition("/")[0]
            if key in files:
                raise Unsafe(f"below a file: {p}")
    return places


def _tar(content: bytes) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
        # the archive's own folder may stand as a member
        members = [m for m in archive.getmembers() if not (m.isdir() and m.name.strip("./\\") == "")]
        for m in members:
            if not (m.isfile() or m.isdir() or m.issym() or m.islnk()):
                raise Unsafe(f"special: {m.name}")
        places = _checked([(m.name, m.isdir()) for m in members])
        at = dict(zip(places, members, strict=True))

        def target(p: str) -> str:
            met: set[str] = set()
            while at[p].issym() or at[p].islnk():
                if p in met:
                    raise Unsafe(f"link loop: {p}")
                met.add(p)
                said = at[p].linkname.replace("\\", "/")
                if said.startswith("/") or re.match(r"[A-Za-z]:", said):
                    raise Unsafe(f"absolute link: {p}")
                # a symbolic link is read from its own folder, a hard link from the archive's
                p = posixpath.normpath(posixpath.join(posixpath.dirname(p), said) if at[p].issym() else said)
                if p not in at:
                    raise Unsafe(f"link to nothing inside: {said}")
            if not at[p].isfile():
                raise Unsafe(f"link to a folder: {p}")
            return p

        found = [(p, target(p)) for p in places if not at[p].isdir()]
        for p, real in found:
            yield p, archive.extractfile(at[real]).read()


def _zip(content: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        infos = archive.infolist()
        for info in infos:
            if stat.S_ISLNK(info.external_attr >> 16):
                raise Unsafe(f"link: {info.filename}")
        for p, info in zip(_checked([(i.filename, i.is_dir()) for i in infos]), infos, strict=True):
            if not info.is_dir():
                yield p, archive.read(info)


def members_of(files: DataFrame) -> DataFrame:
    """(archive, member, size, content, problem) of archives (path, content).

    An unsafe or damaged archive gives one row with its problem and no member;
    an archive without files gives none. Content is read after all names and
    links have been judged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_py() or b""
                try:
                    rows = [(path.as_py(), p, len(c), c, None) for p, c in (_zip if data[:2] == b"PK" else _tar)(data)]
                except (Unsafe, tarfile.TarError, zipfile.BadZipFile, EOFError, OSError, RuntimeError) as problem:
                    rows = [(path.as_py(), None, None, None, str(problem) if isinstance(problem, Unsafe) else f"damaged: {type(problem).__name__}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in MEMBERS.split(", ")])

    return shipped(files).select("path", "content").mapInArrow(run, MEMBERS)
