"""Reading, selecting and parsing files."""

import pytest
from pyspark.sql import functions as F

from palisade.functions import paths
from palisade.model import COMMIT_LINE_SCHEMA
from palisade.operators import packages
from palisade.plans import scanners as plans
from palisade.sources import files as src


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, data in {
        "repo=7/app.ts": b"export const x = 1;\n",
        "repo=7/notes.md": b"# notes\n",
        "repo=7/.env": b"SECRET=abc\n",
        "repo=7/src/deep/a.b.tsx": b"\xef\xbb\xbfx",
        "repo=7/bin.js": b"a\x00b",
        "repo=7/bad.js": b"a\xffb",
        "repo=7/node_modules/x.js": b"1",
        "repo=7/.git/config": b"1",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(root)


def names(df):
    return sorted(r.path for r in df.select("path").collect())


def test_reads_a_tree(spark, tree):
    rows = src.read_files(spark, tree)
    assert names(rows) == [".env", "app.ts", "bad.js", "bin.js", "notes.md", "src/deep/a.b.tsx"]
    assert {r.repo_id for r in rows.collect()} == {7}


def test_reads_one_file_and_a_missing_target(spark, tree):
    assert names(src.read_files(spark, tree, target="repo=7/app.ts")) == ["app.ts"]
    assert names(src.read_files(spark, tree, target="repo=7/.env")) == [".env"]
    assert src.read_files(spark, tree, target="repo=7/nope.ts").count() == 0


def test_reads_a_file_in_pieces(spark, tree, tmp_path):
    """Pieces are the content, in order; a task holds a piece of a large file, not the file."""
    import pyarrow as pa

    whole = {r.path: bytes(r.content) for r in src.read_files(spark, tree).collect()}
    parts = {}
    for r in src.read_files(spark, tree, piece_bytes=4).orderBy("file", "piece").collect():
        assert len(r.content) <= 4 and r.size == len(whole[r.path])
        parts[r.path] = parts.get(r.path, b"") + bytes(r.content)
    assert parts == whole
    (tmp_path / "large").write_bytes(b"x" * (200 << 20))
    (tmp_path / "empty").write_bytes(b"")
    listed = pa.RecordBatch.from_pydict({"full": [f"{tmp_path}/large", f"{tmp_path}/empty"], "size": [200 << 20, 0]})
    before = pa.total_allocated_bytes()
    read, peak = 0, 0
    for batch in src._read(listed, None, 1 << 20):
        read += batch.num_rows
        peak = max(peak, batch.nbytes, pa.total_allocated_bytes() - before)
    assert read == 201 and peak < 64 << 20


def test_from_a_tree_to_findings(spark, tree):
    lines = spark.createDataFrame([], COMMIT_LINE_SCHEMA)
    tracked = spark.createDataFrame([(7, ".env")], "repo_id bigint, path string")
    advisories = spark.createDataFrame([], packages.ADVISORY_SCHEMA)
    found = {r.id for r in plans.tree_findings(spark, tree, tracked, lines, advisories).collect()}
    assert {"git-env-tracked", "supply-chain-no-package-json"} <= found


def test_extensions(spark, tree):
    rows = src.read_files(spark, tree)
    assert "notes.md" not in names(src.filter_extension(rows))
    assert names(src.filter_extension(rows, [".sql"])) == [".env"]
    assert names(src.filter_extension(rows, [".ts"])) == [".env", "app.ts"]


def test_binary_files_are_dropped_and_text_decoded(spark, tree):
    rows = src.decode_text(src.filter_readable(src.read_files(spark, tree)))
    texts = {r.path: r.content for r in rows.collect()}
    assert "bin.js" not in texts
    assert texts["bad.js"] == "a�b"
    assert texts["src/deep/a.b.tsx"] == "﻿x"


def test_a_nul_anywhere_makes_a_file_unreadable(spark):
    rows = spark.createDataFrame([(1, "a" * 100_000 + "\0b"), (2, "a" * 6_000_000)], "k int, content string")
    assert [r.k for r in src.filter_readable(rows).collect()] == [2]


def test_size_limit(spark):
    rows = spark.createDataFrame([(1, "é" * 10), (2, "a" * 10)], "k int, content string")
    assert [r.k for r in src.filter_readable(rows, max_bytes=15).collect()] == [2]


@pytest.mark.parametrize(
    "path, ext, doc, test, skipped",
    [
        ("a/b.TS", ".ts", False, False, False),
        (".env.local", ".local", False, False, False),
        (".env", "", False, False, False),
        ("README", "", True, False, False),
        ("Changelog.rst", ".rst", True, False, False),
        ("readmes.ts", ".ts", False, False, False),
        ("tests/a.ts", ".ts", False, True, False),
        ("src/a.spec.tsx", ".tsx", False, True, False),
        ("src/latest/a.ts", ".ts", False, False, False),
        (".git/config", "", False, False, True),
        ("a/.cache/x.ts", ".ts", False, False, True),
        (".env/x.ts", ".ts", False, False, False),
        ("a/node_modules/b.js", ".js", False, False, True),
        ("my_node_modules/b.js", ".js", False, False, False),
        ("dist.ts", ".ts", False, False, False),
    ],
)
def test_path_predicates(spark, path, ext, doc, test, skipped):
    p = F.lit(path)
    row = spark.range(1).select(
        paths.extension(p).alias("ext"),
        paths.is_doc_file(p).alias("doc"),
        paths.is_test_or_example(p).alias("test"),
        paths.in_skipped_directory(p).alias("skipped"),
    ).first()
    assert tuple(row) == (ext, doc, test, skipped)


def test_ignore_file_matches_exact_names_only(make_files):
    files = make_files(
        {
            ".gitignore": " build2/ \n#src\n*.log\nlib/one.ts\nsecret.ts\n",
            "build2/a.ts": "1",
            "src/a.ts": "1",
            "x.log": "1",
            "lib/one.ts": "1",
            "deep/secret.ts": "1",
            "one.ts": "1",
        },
        {"secret.ts": "1"},
    )
    left = src.filter_ignored(files.select("repo_id", "path"), files).collect()
    assert sorted((r.repo_id, r.path) for r in left) == [
        (0, ".gitignore"), (0, "one.ts"), (0, "src/a.ts"), (0, "x.log"), (1, "secret.ts"),
    ]


def test_manifests(make_files):
    files = make_files(
        {"package.json": '{"dependencies": {"a": "1"}}'},
        {"package.json": "{broken"},
        {"package.json": "null"},
        {"sub/package.json": "{}"},
        {"package.json": '{"name": "a", "dependencies": {"x": "0"}, "name": "b", "dependencies": {"y": "1", "z": "2", "y": "3"}}'},
        {"package.json": '1, "b": 2'},
        {"package.json": "{} x"},
        {"package.json": ""},
    )
    rows = {r.repo_id: r for r in src.parse_manifests(files).collect()}
    assert rows[4].valid and rows[4].dependencies == {"y": "3", "z": "2"}
    assert not rows[5].valid and not rows[6].valid and not rows[7].valid
    assert rows[0].valid and rows[0].dependencies == {"a": "1"}
    assert not rows[1].valid and rows[1].dependencies is None
    assert not rows[2].valid
    assert 3 not in rows


def test_firebase_rules_priority(make_files):
    files = make_files(
        {"firebase.json": '{"firestore": {"rules": "x.rules"}, "database": {"rules": "y"}}', "a.rules": "1"},
        {"firebase.json": '{"database": {"rules": "./y.json"}}', "a.rules": "1"},
        {"firebase.json": "{}", "z/b.rules": "1", "a.rules": "1", ".gitignore": "a.rules"},
        {"storage.rules": "1", "database.rules": "1", ".gitignore": "storage.rules\ndatabase.rules"},
        {"firebase.json": "{}"},
    )
    rows = {r.repo_id: (r.path, r.priority) for r in src.resolve_firebase_rules(files).collect()}
    assert rows == {
        0: ("x.rules", 1), 1: ("y.json", 2), 2: ("z/b.rules", 3), 3: ("database.rules", 5),
    }
