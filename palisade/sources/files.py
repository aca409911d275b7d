"""Reading and selecting source files.

Every selection except the ignore file is a narrow predicate.  The ignore file is the one
relation between files of a repository; it works on (repo_id, path) keys only, so file
contents are never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import ignore, lexing, paths
from palisade.session import stored

MANIFEST_SCHEMA = "dependencies map<string,string>, devDependencies map<string,string>"
IGNORE_FILE = ".gitignore"
MANIFEST = "package.json"


def read_files(
    spark: SparkSession,
    root: str,
    repo_pattern: str = r"/repo=(\d+)/(.*)$",
    target: str | None = None,
    max_bytes: int | None = None,
    piece_bytes: int | None = None,
) -> DataFrame:
    """Files below ``root`` as (repo_id, path, size, content binary).

    ``repo_pattern`` takes the repository number and the relative path out of the full
    path.  ``target`` limits the read to one file or folder below the root; a missing
    target gives no rows.  Only if ``max_bytes`` is given, larger contents are not read (NULL).
    With ``piece_bytes`` a file is as many rows as it has pieces of that size (one, if it is empty), with the columns ``file`` (its full
    path) and ``piece`` (from 0): a row then holds a piece and a task never a whole file, however large the file is.

    Spark's own file sources leave out names that start with a dot, which are exactly the
    ``.env`` and ignore files a scan needs.  So the tree is walked level by level: the folders of a level are
    dealt to all tasks, each lists its own, and what they find is written and is the next level.  A
    task holds the listing of one folder, skipped directories are never listed, and one huge repository
    spreads over all tasks.  Then the files are dealt anew and read.  Tables of files (the usual input
    at scale) need no walk: read them with ``spark.read``.
    """
    start = root.rstrip("/") if target is None else f"{root.rstrip('/')}/{target}"
    level = spark.createDataFrame([(start, "")], "start string, below string")
    found: list[DataFrame] = []
    while True:
        listed = stored(level.repartition("below").mapInPandas(_list_folders, LISTING_SCHEMA))
        found.append(listed.where("not folder").select("full", "size"))
        level = listed.where("folder").select(F.lit(start).alias("start"), "below")
        if level.isEmpty():
            break
    files = reduce(DataFrame.union, found)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _read(batch, max_bytes, piece_bytes)

    rows = files.repartition("full").mapInArrow(read, "full string, size bigint, piece int, content binary")
    return rows.select(
        F.regexp_extract("full", repo_pattern, 1).try_cast("bigint").alias("repo_id"),
        F.regexp_extract("full", repo_pattern, 2).alias("path"),
        "size",
        *([F.col("full").alias("file"), F.col("piece")] if piece_bytes else []),
        "content",
    )


LISTING_SCHEMA = "full string, below string, size bigint, folder boolean"


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of each folder ``start + below``; of a start that is a file, the file."""
    for batch in batches:
        for start, below in zip(batch["start"], batch["below"], strict=True):
            filesystem, base = fs.FileSystem.from_uri(start)
            here = f"{base}{below}"
            info = filesystem.get_file_info(here)
            rows = []
            if info.type == fs.FileType.File:
                if not paths.SKIPPED_SEGMENT.search(info.base_name):
                    rows.append((start, below, info.size, False))
            elif info.type == fs.FileType.Directory:
                for entry in filesystem.get_file_info(fs.FileSelector(here)):
                    name = f"{below}/{entry.base_name}"
                    folder = entry.type == fs.FileType.Directory
                    if not (folder and paths.SKIPPED_SEGMENT.search(f"{name[1:]}/")):
                        rows.append((f"{start}{name}", name, entry.size, folder))
            yield pd.DataFrame(rows, columns=["full", "below", "size", "folder"]).astype({"size": "Int64"})


def _pieces(full: str, size: int, max_bytes: int | None, piece_bytes: int | None) -> Iterator[bytes | None]:
    """Content of a file, whole or piece by piece; None of one that is too large."""
    if max_bytes is not None and size > max_bytes:
        yield None
        return
    filesystem, path = fs.FileSystem.from_uri(full)
    with filesystem.open_input_stream(path) as stream:
        yield (content := stream.read(piece_bytes))
        while piece_bytes and content and (content := stream.read(piece_bytes)):
            yield content


def _read(
    files: pa.RecordBatch, max_bytes: int | None, piece_bytes: int | None = None, batch_bytes: int = 1 << 24
) -> Iterator[pa.RecordBatch]:
    """Contents of files, in batches of bounded size."""
    rows, held = [], 0
    for full, size in zip(files["full"].to_pylist(), files["size"].to_pylist(), strict=True):
        for piece, content in enumerate(_pieces(full, size, max_bytes, piece_bytes)):
            if rows and held + len(content or b"") > batch_bytes or len(rows) >= 1000:
                yield _rows(rows)
                rows, held = [], 0
            rows.append((full, size, piece, content))
            held += len(content or b"")
            del content
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple[str, int, int, bytes | None]]) -> pa.RecordBatch:
    """Batch of (full, size, piece, content); the content of a single row is not copied."""
    full, size, piece, contents = zip(*rows, strict=True)
    if len(rows) == 1 and contents[0] is not None:
        ends = pa.array([0, len(contents[0])], pa.int32()).buffers()[1]
        content = pa.BinaryArray.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(contents[0])])
    else:
        content = pa.array(contents, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.string()), pa.array(size, pa.int64()), pa.array(piece, pa.int32()), content],
        names=["full", "size", "piece", "content"],
    )


def is_readable(content: Column, max_bytes: int | None = None) -> Column:
    """No NUL anywhere (text or binary column); with ``max_bytes`` also not larger than that."""
    data = content.cast("binary")
    text = ~F.contains(data, F.lit(b"\x00"))
    return text if max_bytes is None else (F.octet_length(data) <= max_bytes) & text


def filter_readable(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    return files.where(is_readable(F.col("content"), max_bytes))


def decode_text(files: DataFrame) -> DataFrame:
    """Binary contents of readable files as UTF-8 text (a byte order mark stays)."""
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def filter_extension(
    files: DataFrame, extensions: Sequence[str] = paths.DEFAULT_EXTENSIONS
) -> DataFrame:
    return files.where(paths.has_extension(F.col("path"), extensions))


def filter_skip_dirs(files: DataFrame) -> DataFrame:
    return files.where(~paths.in_skipped_directory(F.col("path")))


def ignore_names(files: DataFrame) -> DataFrame:
    """(repo_id, names): exact names listed in each repository's root ignore file."""
    return files.where(F.col("path") == IGNORE_FILE).select(
        "repo_id", ignore.ignore_entries(F.col("content")).alias("_ignore_names")
    )


def filter_ignored(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Drop rows(repo_id, path, ...) whose path the repository's ignore file names.

    A name excludes a path as its base name, its whole relative path or one of its
    directory names.  ``rows`` may be files or, much cheaper, the hits of a scan: they are
    evaluated once and contents need not be shuffled.  The other side has one row per
    repository, so when a repository is oversized the adaptive skew join splits its rows
    and repeats that single row; it is only broadcast below the optimizer's threshold.
    """
    return without_ignored(rows, ignore_names(files))


def without_ignored(rows: DataFrame, ignored: DataFrame) -> DataFrame:
    """The same, given (repo_id, _ignore_names)."""
    path = F.col("path")
    names = F.concat(F.split(path, "/"), F.array(path))
    hidden = F.arrays_overlap("_ignore_names", names)
    return (
        rows.join(ignored, "repo_id", "left")
        .where(~F.coalesce(hidden, F.lit(False)))
        .drop("_ignore_names")
    )


def explode_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """files -> one row per line with its 0-based index ``i``."""
    others = [c for c in files.columns if c != text]
    return files.select(*others, F.posexplode(lexing.lines_of(F.col(text))).alias("i", "line"))


def manifest_columns(text: Column) -> list[Column]:
    """``raw, valid, dependencies, devDependencies`` of a manifest's text; not valid where there is none."""
    parsed = F.from_json(text, MANIFEST_SCHEMA)
    # One JSON value, repeated keys allowed: one element of a list, and the value of a field.
    field = F.concat(F.lit('{"it": '), text, F.lit("}"))
    whole = F.from_json(field, "it string, broken string", {"columnNameOfCorruptRecord": "broken"})
    single = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    valid = F.coalesce(single, F.lit(False)) & whole["broken"].isNull() & whole["it"].isNotNull()
    return [
        text.alias("raw"),
        valid.alias("valid"),
        *(F.when(valid, _last_of_each(parsed[c])).alias(c) for c in ("dependencies", "devDependencies")),
    ]


def parse_manifests(files: DataFrame) -> DataFrame:
    """Root package.json of each repository; maps are NULL where absent or invalid.

    ``valid`` is false where the text is no JSON (or the JSON value null).  Of a key that is given
    twice the last value counts, at the top and inside the maps.
    """
    text = F.col("content")
    return files.where((F.col("path") == MANIFEST) & is_readable(text)).select("repo_id", *manifest_columns(text))


def _last_of_each(entries: Column) -> Column:
    """Map with one entry per key, at the key's first place and with its last value."""
    keys, values = F.map_keys(entries), F.map_values(entries)
    last = F.transform(
        F.array_distinct(keys),
        lambda k: F.struct(
            k.alias("key"),
            F.get(values, F.array_size(keys) - F.array_position(F.reverse(keys), k).cast("int")).alias("value"),
        ),
    )
    return F.map_from_entries(last)


def select_rules_files(files: DataFrame) -> DataFrame:
    from palisade.operators.rules_files import is_rules_file

    return files.where(is_rules_file(F.col("path")))


def resolve_firebase_rules(files: DataFrame) -> DataFrame:
    """(repo_id, path, priority): the one rules file that counts per repository.

    ``files`` may be an outline of the files, with their readability as a column.  Named by firebase.json (firestore, then database), else the first ``.rules`` file the
    walk finds, else one of three fixed root names even if ignored.
    Only keys are grouped; the partial ``min`` keeps one row per repository and task.
    """
    content = F.col("content")
    config = files.where((F.col("path") == "firebase.json") & is_readable(content)).select(
        "repo_id",
        F.get_json_object(content, "$.firestore.rules").alias("firestore"),
        F.get_json_object(content, "$.database.rules").alias("database"),
    )
    return rules_that_count(files, config, ignore_names(files))


def rules_that_count(files: DataFrame, config: DataFrame, ignored: DataFrame) -> DataFrame:
    """The same, given (repo_id, firestore, database) of firebase.json and (repo_id, _ignore_names)."""
    path, content = F.col("path"), F.col("content")
    named = config.select(
        "repo_id",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit(1).alias("priority"), F.col("firestore").alias("path")),
                    F.struct(F.lit(2).alias("priority"), F.col("database").alias("path")),
                ),
                lambda c: c["path"].isNotNull() & (c["path"] != ""),
            )
        ).alias("c"),
    ).select("repo_id", "c.priority", F.regexp_replace("c.path", r"^\./", "").alias("path"))
    readable = F.col("readable") if "readable" in files.columns else is_readable(content)
    rules = files.where(paths.extension(path) == ".rules").select("repo_id", "path", readable.alias("ok"))
    walked = without_ignored(
        rules.where(~paths.in_skipped_directory(path)).select("repo_id", "path"), ignored
    ).select("repo_id", F.lit(3).alias("priority"), "path")
    fixed = rules.where(F.col("ok")).select(
        "repo_id",
        F.when(path == "firestore.rules", 4)
        .when(path == "database.rules", 5)
        .when(path == "storage.rules", 6)
        .alias("priority"),
        "path",
    ).where(F.col("priority").isNotNull())
    return (
        named.unionByName(walked)
        .unionByName(fixed)
        .groupBy("repo_id")
        .agg(F.min(F.struct("priority", "path")).alias("best"))
        .select("repo_id", "best.path", "best.priority")
    )
