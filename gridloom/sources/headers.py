"""Headers of PCD and PLY files, and which of the two a file is."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

import numpy as np

from gridloom.sources import files


class Format(Enum):
    UNKNOWN = "UNKNOWN"
    PCD = "PCD"
    PLY = "PLY"


EXTENSIONS = {".pcd": Format.PCD, ".ply": Format.PLY}


class BadCloudFile(ValueError):
    """A point cloud file that can't be read as it says it is."""


@dataclass
class Header:
    format: Format
    #: ascii or binary.
    kind: str
    points: int
    #: Field names with their numpy types, in order.
    fields: list[tuple[str, str]] = field(default_factory=list)
    #: Where the points begin.
    start: int = 0
    version: str = ""
    comments: list[str] = field(default_factory=list)
    #: Whether other elements' lines follow the points.
    more: bool = False

    @property
    def dtype(self) -> np.dtype:
        names, seen = [], set()
        for i, (name, kind) in enumerate(self.fields):
            names.append((name if name not in seen else f"{name}#{i}", kind))
            seen.add(name)
        return np.dtype(names)

    def xyz(self) -> list[int]:
        """Places of x, y, z among the fields; in a PCD file without such names, the first three."""
        names = [n.lower() if self.format is Format.PCD else n for n, _ in self.fields]
        if all(a in names for a in "xyz"):
            return [names.index(a) for a in "xyz"]
        if self.format is Format.PCD and len(names) >= 3 or not names:
            return [0, 1, 2]
        raise BadCloudFile("the file has no x, y and z")


def _lines(data: bytes):
    """(line without its end, offset after it) of the head of a file."""
    at = 0
    while (end := data.find(b"\n", at)) >= 0:
        yield data[at:end].decode("latin-1").rstrip(), end + 1
        at = end + 1
    if at < len(data):
        yield data[at:].decode("latin-1").rstrip(), len(data)


_PCD_TYPES = {"F": "f", "I": "i", "U": "u"}


def pcd_header(data: bytes) -> Header:
    """From the first bytes of a PCD file. SIZE, TYPE and COUNT say how wide a binary record is; floats if absent."""
    said: dict[str, list[str]] = {}
    for line, after in _lines(data):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        said[words[0]] = words[1:]
        if words[0] == "DATA":
            break
    else:
        raise BadCloudFile("a PCD header without DATA")
    points = int((said.get("POINTS") or ["0"])[0])
    if points <= 0:
        raise BadCloudFile("a PCD header without points")
    kind = (said["DATA"] or [""])[0]
    if kind == "binary_compressed":
        raise BadCloudFile("compressed PCD data isn't supported")
    if kind not in ("ascii", "binary"):
        raise BadCloudFile(f"PCD data {kind!r}")
    names = said.get("FIELDS") or ["x", "y", "z"]
    n = len(names)
    sizes, types, counts = (said.get(k) or [d] * n for k, d in (("SIZE", "4"), ("TYPE", "F"), ("COUNT", "1")))
    fields = []
    for name, size, type_, count in zip(names, sizes, types, counts):
        fields += [(name if k == 0 else f"{name}.{k}", f"<{_PCD_TYPES.get(type_, 'f')}{size}") for k in range(int(count))]
    return Header(Format.PCD, kind, points, fields, after, (said.get("VERSION") or [""])[0])


_PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def ply_header(data: bytes) -> Header:
    """From the first bytes of a PLY file; only the vertex element's properties count, and it must come first."""
    lines = _lines(data)
    if next(lines, ("", 0))[0] != "ply":
        raise BadCloudFile("not a PLY file")
    kind = version = element = None
    points, fields, comments, earlier, more = None, [], [], False, False
    for line, after in lines:
        words = line.split()
        if not words:
            continue
        if words[0] == "format" and len(words) > 1:
            kind, version = words[1], (words[2:] or [""])[0]
        elif words[0] == "comment":
            comments.append(line[len("comment") :].strip())
        elif words[0] == "element" and len(words) > 2:
            element = words[1]
            if element == "vertex":
                points = int(words[2])
            elif points is None and int(words[2]):
                earlier = True
            elif int(words[2]):
                more = True
        elif words[0] == "property" and element == "vertex" and len(words) > 2:
            if words[1] == "list":
                raise BadCloudFile("a vertex with a list property")
            fields.append((words[2], "<" + _PLY_TYPES.get(words[1], "f4")))
        elif words[0] == "end_header":
            break
    else:
        raise BadCloudFile("a PLY header without an end")
    if kind is None or points is None:
        raise BadCloudFile("a PLY header without format or vertices")
    if kind not in ("ascii", "binary_little_endian"):
        raise BadCloudFile(f"PLY format {kind!r} isn't supported")
    if earlier:
        raise BadCloudFile("vertices that don't come first")
    return Header(Format.PLY, "ascii" if kind == "ascii" else "binary", points, fields, after, version, comments, more)


def by_extension(path: str) -> Format:
    name = path.replace("\\", "/").rpartition("/")[2]
    dot = name.rfind(".")
    return EXTENSIONS.get(name[dot:].lower(), Format.UNKNOWN) if dot >= 0 else Format.UNKNOWN


def by_content(data: bytes) -> Format:
    """What the first five lines that aren't blank say, if a header of that kind follows."""
    first = [line for line, _ in _lines(data) if line][:5]
    try:
        if first[:1] == ["ply"]:
            return ply_header(data).format
        if any(line.startswith(("# .PCD", "VERSION", "FIELDS", "POINTS")) for line in first):
            return pcd_header(data).format
    except (BadCloudFile, ValueError):
        pass
    return Format.UNKNOWN


def detect(path: str) -> Format:
    """By content, else by extension; UNKNOWN for a file that isn't there."""
    if not files.exists(path):
        return Format.UNKNOWN
    found = by_content(files.head(path)) if files.is_file(path) else Format.UNKNOWN
    return found if found is not Format.UNKNOWN else by_extension(path)


def supported(path: str) -> bool:
    """Whether an existing file is of a known format."""
    return files.is_file(path) and detect(path) is not Format.UNKNOWN


def header(path: str) -> Header:
    if not files.is_file(path):
        raise BadCloudFile(f"no such file: {path}")
    found, data = detect(path), files.head(path)
    if found is Format.UNKNOWN:
        raise BadCloudFile(f"neither PCD nor PLY: {path}")
    return pcd_header(data) if found is Format.PCD else ply_header(data)


@dataclass
class FileInfo:
    """What is known of a file before it is read."""

    path: str
    detected: Format
    extension: Format
    points: int = 0
    error: str = ""

    @property
    def mismatch(self) -> bool:
        return Format.UNKNOWN not in (self.detected, self.extension) and self.detected is not self.extension


def describe(path: str) -> FileInfo:
    out = FileInfo(path, detect(path), by_extension(path))
    try:
        out.points = header(path).points
    except (BadCloudFile, ValueError) as e:
        out.error = str(e)
    return out
