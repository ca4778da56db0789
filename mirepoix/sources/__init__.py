"""Readers, writers and typing of raw tables."""

from mirepoix.sources.columnar import read_columnar, stage, unstage, write_columnar
from mirepoix.sources.delimited import (
    AS_IS,
    PIPE,
    TAB,
    delimited_path,
    read_delimited,
    write_delimited,
    write_report,
)
from mirepoix.sources.libsvm import read_libsvm, write_libsvm
from mirepoix.sources.transcode import read_encoded_lines, transcode
from mirepoix.sources.typed import cast_except
from mirepoix.sources.workspace import fresh_path, shared_folder

__all__ = [
    "AS_IS",
    "PIPE",
    "TAB",
    "cast_except",
    "delimited_path",
    "fresh_path",
    "read_columnar",
    "read_delimited",
    "read_encoded_lines",
    "read_libsvm",
    "shared_folder",
    "stage",
    "transcode",
    "unstage",
    "write_columnar",
    "write_delimited",
    "write_libsvm",
    "write_report",
]
