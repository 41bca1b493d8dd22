"""File names: type, supported or not, and the name of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by extension.
TYPES = {".docx": "docx", ".pdf": "pdf"}
_EXTENSION = r"[^/.][^/]*(\.[^./]*)$"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot; empty for names without one and for names that only begin with a dot."""
    return F.regexp_extract(path, _EXTENSION, 1)


def file_type(path: Column) -> Column:
    """docx, pdf or unsupported (null and empty paths too)."""
    low = F.lower(extension(path))
    out = F.lit("unsupported")
    for ext, name in TYPES.items():
        out = F.when(low == ext, F.lit(name)).otherwise(out)
    return out


def result_name(path: Column) -> Column:
    """The base name with .md for its last extension."""
    name = base_name(path)
    return F.concat(F.substr(name, F.lit(1), F.length(name) - F.length(extension(name))), F.lit(".md"))


def upload_allowed(name: Column) -> Column:
    """What the upload form takes: the text after the last dot is a known extension."""
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin([e[1:] for e in TYPES])
