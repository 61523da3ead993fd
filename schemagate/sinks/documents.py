"""Sink of documents as files, one each, committed together.

Tasks write below a passing folder next to the final one; what they hand back are the names of their files. Only when
all tasks are done does the driver move these to their places; a failed job leaves no file, and files of task attempts
that did not count are never moved. Any store that Arrow opens on driver and executors will do.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from schemagate.sources.stores import store_of


@dataclass
class Written(WriterCommitMessage):
    """Files of a task attempt: its passing folder, and names below it."""

    folder: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, directory: str):
        self.directory = directory
        self.passing = f"_passing-{uuid4().hex}"

    def _place(self, *parts: str):
        store, top = store_of(self.directory)
        return store, posixpath.join(top, *parts)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = posixpath.join(self.passing, uuid4().hex)
        store, top = self._place(folder)
        store.create_dir(top, recursive=True)
        names: list[str] = []
        out, open_name = None, None
        for batch in iterator:
            for name, part_no, document in zip(*(batch[c].to_pylist() for c in ("file_path", "part_no", "document"))):
                if name != open_name:
                    if out:
                        out.close()
                    if part_no != 0 or name in names[-1:]:
                        raise ValueError(f"parts of {name} are not in order")
                    store.create_dir(posixpath.dirname(posixpath.join(top, name)), recursive=True)
                    out, open_name = store.open_output_stream(posixpath.join(top, name)), name
                    names.append(name)
                out.write(document.encode("utf-8"))
        if out:
            out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, final = self._place()
        for message in messages:
            for name in message.names if message else []:
                target = posixpath.join(final, name)
                store.create_dir(posixpath.dirname(target), recursive=True)
                store.move(posixpath.join(final, message.folder, name), target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = self._place(self.passing)
        if store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)


class DocumentFiles(DataSource):
    """Write rows (file_path, part_no, n_parts, document), parts of a file in order and in one task, below a path."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "file_path string, part_no bigint, n_parts bigint, document string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])
