"""A data source that writes one FASTA file a bin.

Rows come by bin, each bin wholly in one task and in order; a task streams a bin's records to
a file of its own attempt, beside the target. The commit, on the driver, moves the files of the
attempts that count to their names, so that a task that was run twice leaves no second copy,
and removes the rest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = "_staging"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.run = uuid.uuid4().hex

    def _system(self):
        from pyarrow import fs

        uri = self.path if "://" in self.path or self.path.startswith("file:") else "file://" + self.path
        return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)

    def write(self, iterator):
        system, root = self._system()
        folder = f"{root}/{STAGING}-{self.run}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        files, label, out = [], None, None
        for row in iterator:
            if row.bin != label:
                if out:
                    out.close()
                label = row.bin
                files.append((f"{folder}/{len(files)}", f"{root}/{label}.fa"))
                out = system.open_output_stream(files[-1][0], compression=None)
            out.write(f"{row.value}\n".encode())
        if out:
            out.close()
        return _Written(files)

    def commit(self, messages):
        system, root = self._system()
        system.create_dir(root, recursive=True)
        for m in messages:
            for made, name in m.files if m else ():
                if system.get_file_info(name).is_file:
                    system.delete_file(name)
                system.move(made, name)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        system, root = self._system()
        folder = f"{root}/{STAGING}-{self.run}"
        if not system.get_file_info(folder).type.name == "NotFound":
            system.delete_dir(folder)


class BinFiles(DataSource):
    """Writes rows (bin, value) sorted by bin; option path."""

    @classmethod
    def name(cls):
        return "bin_files"

    def schema(self):
        return "bin string, value string"

    def writer(self, schema, overwrite):
        return _Writer(self.options)
