from __future__ import annotations

import json

import pytest

from sparkloom import schemas
from sparkloom.operators import manifest as M

SHA = "a" * 64
OTHER = "b" * 64


def diff(spark, old, new, **options):
    a = spark.createDataFrame(old, schemas.FILE_ENTRY)
    b = spark.createDataFrame(new, "path string, sha256 string, mtime_ns bigint")
    return sorted((r.path, r.change_type, r.old_chunk_ids) for r in M.changes(a, b, **options).collect())


def test_changes(spark):
    old = [("same", SHA, 1, ["c1"]), ("touched", SHA, 1, ["c2"]), ("edited", SHA, 1, ["c3"]), ("gone", SHA, 1, ["c4", "c5"]), ("fast", SHA, 1, ["c6"])]
    new = [("same", SHA, 1), ("touched", SHA, 2), ("edited", OTHER, 2), ("fast", OTHER, 1), ("new", SHA, 1)]
    assert diff(spark, old, new) == [("edited", "modify", ["c3"]), ("gone", "delete", ["c4", "c5"]), ("new", "add", [])]
    assert [x[:2] for x in diff(spark, old, new, check_hashes=False)] == [("edited", "modify"), ("gone", "delete"), ("new", "add"), ("touched", "modify")]


def test_parse(spark):
    text = json.dumps({"version": "1.0.0", "files": {"a.md": {"sha256": SHA, "mtime_ns": 5, "chunk_ids": ["c"]}}, "embedding_model": "m", "chunk_config": {"chunk_size": 1000}})
    header, files = M.parse(spark, text)
    assert header.embedding_model == "m" and files.first().asDict() == {"path": "a.md", "sha256": SHA, "mtime_ns": 5, "chunk_ids": ["c"]}


@pytest.mark.parametrize(("data", "error"), [
    ("not json", M.CorruptManifest), (json.dumps({"files": {}}), M.ManifestError), (json.dumps({"version": "1.0.0"}), M.ManifestError), (json.dumps({"version": "1", "files": {}}), M.ManifestError),
    (json.dumps({"version": "1.0.0", "files": []}), M.ManifestError), (json.dumps({"version": "1.0.0", "files": {"a": {"sha256": "x"}}}), M.ManifestError),
    (json.dumps({"version": "1.0.0", "files": {"../a": {"sha256": SHA}}}), M.ManifestError), (json.dumps({"version": "1.0.0", "files": {"a": {"sha256": SHA, "chunk_ids": ["c"] * 10_001}}}), M.ManifestError),
])
def test_invalid_manifests(spark, data, error):
    with pytest.raises(error):
        M.parse(spark, data)


def test_size_limit(spark):
    with pytest.raises(M.ManifestError):
        M.parse(spark, "{}", size=M.MAX_BYTES + 1)


@pytest.mark.parametrize("path", ["../x", "/etc", "C:/x", "a\x00b", "a\nb", ""])
def test_unsafe_paths(spark, path):
    rows = spark.createDataFrame([(path, SHA, 0, [])], schemas.FILE_ENTRY)
    assert M.violations(rows).first().problem == "unsafe path"


def test_rebuild_reasons():
    assert M.rebuild_reason(None, "m", {}) == "No manifest exists"
    assert "model changed" in M.rebuild_reason(M.Header("a"), "b", {})
    assert M.rebuild_reason(M.Header("", {}), "b", {"x": 1}) == ""
    assert "configuration" in M.rebuild_reason(M.Header("b", {"x": 2}), "b", {"x": 1})
