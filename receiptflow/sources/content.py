"""A content store on a shared folder, one file for each SHA-256 digest.

``store_content`` is a map: a task writes the bodies of its rows where they belong,
``<folder>/<first two hex digits>/<digest>``, under a name of its own first and then
by a rename.  Whoever writes a digest writes the same bytes, so retried and
speculative attempts, two tasks with one body and whole reruns leave one file, and
no body is shuffled to find that out.  A file that is there with its whole length
isn't written again.  What a killed attempt left behind has a name that starts with
``_``, which Spark's readers skip.

``fetch_content`` reads bodies in tasks, by digest: nothing lists the store.

The folder is a path or address that pyarrow's file systems know (local and mounted
paths, ``file:``, ``hdfs:``, ``s3:``) and that all executors reach.

Defined results: a null body has a null digest and no file; an empty body is a file of
no bytes; repeated rows give a row each; an absent or damaged file reads as null.
"""
from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bodies of a batch that are held at once while reading.
READ_ROWS = 64


def _file_system(folder: str):
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def _place(base: str, sha: str) -> str:
    return f"{base}/{sha[:2]}/{sha}"


def _write(batches, folder: str):
    fs, base = _file_system(folder)
    made: set[str] = set()
    for batch in batches:
        body = batch.column(batch.num_columns - 1)
        digests, lengths = [], []
        for value in body:
            if not value.is_valid:
                digests.append(None)
                lengths.append(None)
                continue
            data = value.as_buffer()
            sha = hashlib.sha256(data).hexdigest()
            digests.append(sha)
            lengths.append(data.size)
            path = _place(base, sha)
            there = fs.get_file_info(path)
            if there.type == pafs.FileType.File and there.size == data.size:
                continue
            if sha[:2] not in made:
                fs.create_dir(f"{base}/{sha[:2]}", recursive=True)
                made.add(sha[:2])
            own = f"{base}/{sha[:2]}/_{sha}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as out:
                out.write(data)
            fs.move(own, path)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(digests, pa.string()),
                                          pa.array(lengths, pa.int64())],
                                         [*batch.schema.names[:-1], "sha", "n_bytes"])


def _read(batches, folder: str):
    fs, base = _file_system(folder)
    for batch in batches:
        for at in range(0, batch.num_rows, READ_ROWS):
            part = batch.slice(at, READ_ROWS)
            bodies = []
            for sha in part.column(part.num_columns - 1).to_pylist():
                data = None
                if sha is not None and fs.get_file_info(_place(base, sha)).type == pafs.FileType.File:
                    with fs.open_input_stream(_place(base, sha)) as f:
                        data = f.read()
                    if hashlib.sha256(data).hexdigest() != sha:
                        data = None
                bodies.append(data)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bodies, pa.binary())],
                                             [*part.schema.names, "content"])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def store_content(rows: DataFrame, key: str, content: str, folder: str) -> DataFrame:
    """key, sha, n_bytes of every row, its body written to the store.  Writing is part of the
    plan: an action on the result (``session.materialize``) stores the bodies."""
    given = rows.select(F.col(key), F.col(content).cast("binary").alias("content"))
    return given.mapInArrow(lambda b: _write(b, folder), f"{_ddl(given.select(key))}, sha string, n_bytes bigint")


def fetch_content(stored: DataFrame, folder: str, key: str, sha: str = "sha") -> DataFrame:
    """key, sha and the content that the store holds for it."""
    asked = stored.select(F.col(key), F.col(sha).alias("sha"))
    return asked.mapInArrow(lambda b: _read(b, folder), f"{_ddl(asked)}, content binary")
