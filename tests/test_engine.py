from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import catalog, search
from sparkloom.plans import validate as V
from sparkloom.plans.engine import Engine
from sparkloom.sources import files as S
from tests.test_chunking import PROPOSAL
from tests.test_extract import C, RUST


@pytest.fixture
def data(tmp_path):
    for path, text in (("agave/runtime/a.rs", RUST), ("agave/other/skip.rs", RUST), ("firedancer/src/app/b.c", C), ("solana-improvement-documents/proposals/0326-glow.md", PROPOSAL), ("solana-improvement-documents/proposals/deep/x.md", PROPOSAL)):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (tmp_path / "agave/runtime/bad.rs").write_bytes(b"pub const BAD: u8 = 1;\xff\xfe")
    (tmp_path / "agave/runtime/win.rs").write_bytes(b"/// Doc\r\npub const WIN: u8 = 1;\r\n")
    return tmp_path


def test_end_to_end(spark, data):
    engine = Engine(spark, f"file://{data}", "hashing-64")
    files = {r.path for r in engine.files().collect()}
    assert files == {"agave/runtime/a.rs", "agave/runtime/win.rs", "firedancer/src/app/b.c", "solana-improvement-documents/proposals/0326-glow.md"}
    counted = {r.repo: r for r in engine.compile().collect()}
    assert (counted["agave"].functions, counted["agave"].structs, counted["agave"].constants) == (2, 2, 4)
    assert engine.constant("WIN").first().doc_comment == "Doc"
    assert engine.function("add").first().url == "https://github.com/firedancer-io/firedancer/blob/main/src/app/b.c#L13"
    stats = engine.update()
    assert stats.full_rebuild and stats.chunks_added > 8
    assert engine.update().summary() == "No changes"
    hit = engine.search("impl show account owner", 3).orderBy("rank").first()
    assert hit.source_type == "rust"
    assert {r.source_type for r in engine.search("paragraph", 5, "SIMD").collect()} == {"simd"}
    assert engine.call("get_status").filter("source_type IS NULL").first().chunks == stats.chunks_added
    (data / "agave/runtime/win.rs").unlink()
    assert engine.dry_run().estimate["files_deleted"] == 1
    assert engine.update().chunks_deleted == 1


def test_tools(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", "hashing-64")
    assert engine.call("get_client", name="jito").first().name == "Jito-Agave"
    assert engine.call("get_current_version").first().version == "v2.1"
    assert engine.call("list_feature_gates", activated_only=True).count() == 3
    assert engine.call("list_guidance_topics").count() == 16
    assert engine.call("expert_guidance", topic="POH").first().topic == "poh"
    assert engine.call("list_clients", production_only=True).count() == 4
    assert engine.call("get_consensus_status").count() == 1
    with pytest.raises(V.InputError):
        engine.call("nothing")
    with pytest.raises(FileNotFoundError):
        engine.files()


def test_find(spark):
    assert catalog.find_version(spark, "v2").first().version == "v2.0"
    assert catalog.find_client(spark, "dancer").first().name == "Firedancer"
    assert catalog.find_client(spark, "none").count() == 0
    more = catalog.add_guidance(catalog.guidance(spark), "Rent", "Paying for space.")
    assert catalog.find_guidance(more, "rent").first().summary != "" and more.count() == 17
    assert catalog.find_guidance(more, "space").first().topic == "rent"


@pytest.mark.parametrize("bad", [{"query": ""}, {"query": "x" * 1001}, {"query": "x", "limit": 0}, {"query": "x", "limit": 51}, {"query": "x", "source_type": "java"}])
def test_bad_searches(bad):
    with pytest.raises(V.InputError):
        V.Search(**bad)


def test_names_and_paths(tmp_path):
    assert V.constant_name("MAX_1") and V.function_name("_f1") and V.client(" Jito ") == "jito"
    for check, bad in ((V.constant_name, "max"), (V.function_name, "F"), (V.topic, ""), (V.client, "x" * 51)):
        with pytest.raises(V.InputError):
            check(bad)
    assert V.inside(str(tmp_path), "a/b")
    with pytest.raises(V.InputError):
        V.inside(str(tmp_path), "../x")


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    assert V.load_config(str(path)) == V.Config()
    V.save_config(V.Config("m", 8, 500, 50), str(path))
    assert V.load_config(str(path)) == V.Config("m", 8, 500, 50)
    monkeypatch.setenv("SPARKLOOM_BATCH_SIZE", "16")
    assert V.load_config(str(path)).batch_size == 16
    path.write_text("a: [")
    assert V.load_config(str(path)).chunk_size == 1000
    path.write_text("x" * (V.MAX_CONFIG_BYTES + 1))
    with pytest.raises(V.InputError):
        V.load_config(str(path))
    for bad in (V.Config(batch_size=0), V.Config(chunk_size=99), V.Config(chunk_overlap=1000), V.Config(chunk_overlap=-1)):
        with pytest.raises(V.InputError):
            bad.problems()
    with pytest.raises(V.InputError):
        V.Config(model="api").problems({"api": "SPARKLOOM_NO_SUCH_KEY"})
    assert V.Config(model="x", batch_size=300).problems({"y": None}) == ["unknown model x", "batch_size over 256 may exhaust memory"]
    assert V.unknown_keys({"a": 1, "b": 2}, {"a"}) == {"b"}


def test_missing_json_has_no_rows(spark, tmp_path):
    assert S.read_items(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "c.json").write_text('[{"name": "A", "value": "1", "line_number": 3}]')
    assert S.read_constants(spark, f"file://{tmp_path}/c.json").first().value == "1"


def test_command_line(spark, data, capsys):
    from sparkloom import cli

    where = ["--data-dir", f"file://{data}"]
    assert cli.main([*where, "compile"]) == 0
    assert cli.main([*where, "index"]) == 0
    assert cli.main([*where, "constant", "WIN"]) == 0
    assert "Full rebuild" in capsys.readouterr().out


def test_docs_markdown_and_text(spark, data):
    from sparkloom import cli

    page = data / "agave/docs/guide/start.md"
    page.parent.mkdir(parents=True)
    page.write_text("# Start\n\n" + "A guide of more than fifty characters to begin with. " * 2)
    engine = Engine(spark, str(data), "hashing-64")
    assert "agave/docs/guide/start.md" in {r.path for r in engine.files().select("path").collect()}
    run = lambda *args: cli.run(engine, cli._parser().parse_args(["--data-dir", str(data), *args]))
    assert "Would rebuild" in run("index", "--dry-run") and "add: agave/docs/guide/start.md" in run("index", "--dry-run")
    assert "constants: 4" in run("compile")
    assert run("index").startswith("Full rebuild")
    assert run("update") == "No updates found"
    status = run("status")
    assert "repo: agave" in status and "path_prefix: runtime" in status and "exists: true" in status and "chunks:" in status
    found = run("search", "guide to begin with", "--limit", "2")
    assert found.startswith("1. [docs]") and "%)" in found and "   | " in found
    assert run("constant", "WIN").startswith("const WIN: u8 = 1\n   File: agave/runtime/win.rs:2\n   Source: https://")
    assert "fn run(tx: &T)" in run("function", "run") and "```" in run("function", "run")
    assert run("constant", "NONE_SUCH") == "Nothing found"
    assert "line: ## v2.1 (CURRENT)" in run("versions") and engine.tell("get_current_version").startswith("version: v2.1") and "  - Foundation for Alpenglow consensus" in engine.tell("get_current_version")
    assert run("tool", "get_client", "name=sig").startswith("name: Sig")
    assert run("compact", "--cells") == "Written as one segment" and engine.index.quantiser()
    assert run("search", "guide to begin with").startswith("1. [docs]")
    assert run("vacuum").endswith("deleted")
    by = {(r.repo, r.path_prefix): (r["items"], r.constants) for r in engine.counts().collect()}
    assert by["agave", "runtime"] == (6, 4) and by["firedancer", "src/app"][1] == 3
    assert {r.source_type for r in search.sources(engine.index.chunks()).collect()} == {"rust", "simd", "docs"}


def test_guidance_from_a_file(spark, tmp_path):
    import json

    (tmp_path / "g.json").write_text(json.dumps([{"topic": "POH", "key_points": ["one", "two"]}, {"topic": "rent", "title": "Rent", "summary": "Paying for space.", "gotchas": ["g"]}]))
    table = catalog.guidance(spark, str(tmp_path / "g.json"))
    assert table.count() == 17
    poh = catalog.find_guidance(table, "poh").first()
    assert poh.key_points == ["one", "two"] and poh.title == "Proof of History"
    assert catalog.find_guidance(table, "space").first().gotchas == ["g"]
    assert catalog.find_guidance(catalog.guidance(spark), "clock").first().topic == "poh"


def _commit(folder, name, text):
    from sparkloom.sources import repos

    (folder / name).parent.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    repos.git("add", "-A", cwd=folder)
    assert repos.git("-c", "user.name=t", "-c", "user.email=t@example.org", "commit", "-qm", name, cwd=folder).returncode == 0


def test_checkouts(spark, tmp_path, monkeypatch):
    import shutil

    from sparkloom.sources import repos

    if shutil.which("git") is None:
        pytest.skip("no git")
    far = tmp_path / "far"
    far.mkdir()
    repos.git("init", "-q", "-b", "main", cwd=far)
    _commit(far, "runtime/a.rs", "pub const A: u8 = 1;\n")
    _commit(far, "other/b.rs", "pub const B: u8 = 1;\n")
    monkeypatch.setattr(catalog, "REPOS", [("agave", f"file://{far}", "main", True, None, ["runtime"]), ("plain", f"file://{far}", "main", False, None, None), ("gone", f"file://{tmp_path}/nowhere", "main", False, None, None)])
    root, told = str(tmp_path / "data"), []
    assert repos.download(root, None, told.append) == {"agave": True, "plain": True, "gone": False}
    assert repos.download(root, ["unknown", "plain"], told.append) == {"unknown": False, "plain": True}
    assert (tmp_path / "data/agave/runtime/a.rs").exists() and not (tmp_path / "data/agave/other").exists() and (tmp_path / "data/plain/other/b.rs").exists()
    rows = {r.repo: r for r in repos.status(spark, root).collect()}
    assert len(rows["agave"].version) == 12 and rows["gone"].exists is False and rows["gone"].version is None
    assert repos.refreshed(root, told.append) == []
    _commit(far, "runtime/c.rs", "pub const C: u8 = 1;\n")
    engine = Engine(spark, root, "hashing-64")
    engine.compile()
    engine.update()
    _commit(far, "runtime/d.rs", "pub const D: u8 = 1;\n")
    stats = engine.refresh(tell=told.append)
    assert stats.files_added == 2 and engine.constant("D").first().value == "1"
    assert engine.index.header().repo_versions["agave"] == repos.checkouts(root)["agave"].head()
    repos.git("reset", "-q", "--hard", "HEAD~2", cwd=far)
    _commit(far, "runtime/e.rs", "pub const E: u8 = 1;\n")
    assert "agave" in repos.refreshed(root, told.append) and not (tmp_path / "data/agave/runtime/d.rs").exists()


def test_unknown_settings_are_told(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("embedding: {model: hashing, color: red}\nchunking: 7\nmore: 1\n")
    assert V.load_config(str(path)).warnings == ["unknown setting more", "unknown setting embedding.color", "chunking is no mapping"]


def test_manifest_files(spark, tmp_path):
    from sparkloom.operators import manifest as M

    path = tmp_path / "manifest.json"
    assert M.load(spark, str(path)) is None
    path.write_text('{"version": "1.0.0", "files": {"a.md": {"sha256": "%s", "chunk_ids": ["c_1"]}}}' % ("a" * 64))
    header, files = M.load(spark, str(path))
    assert header.version == "1.0.0" and files.first().chunk_ids == ["c_1"]
    path.write_text("{")
    with pytest.raises(M.CorruptManifest):
        M.load(spark, str(path))
    assert (tmp_path / "manifest.json.corrupted").read_text() == "{"


def test_records_from_json(spark, tmp_path):
    assert S.read_items(spark, f"{tmp_path}/none.json").count() == 0
    with pytest.raises(Exception):
        S.read_json(spark, "nofs:///x.json", "a int")


def test_several_patterns(spark, data):
    (data / "agave/runtime/x.rsx").write_text("pub const X: u8 = 1;\n")
    assert {r.path for r in S.rust_files(spark, f"{data}/agave", subdirs=["runtime"], pattern=["win.rs", "*.rsx"]).select("path").collect()} == {"runtime/win.rs", "runtime/x.rsx"}


def test_an_absent_name_reads_no_row_group(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("'r' AS repo", "'a.rs' AS file_path", "concat('N', id) AS name", "'1' AS value", "'u8' AS type_annotation", "'' AS doc_comment", "1 AS line_number")
    S.write_records(rows.repartition(3), f"{tmp_path}/c")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, most in (("N77", 20_000), ("N77x", 0)):
            # statistics and dictionaries aside: the filter of names alone
            table = spark.read.options(**{"parquet.filter.stats.enabled": "false", "parquet.filter.dictionary.enabled": "false", "parquet.filter.columnindex.enabled": "false"}).parquet(f"{tmp_path}/c")
            found = table.filter(F.col("name") == name)
            assert len(found.collect()) == (name == "N77")
            leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
            assert leaf.metrics().apply("numOutputRows").value() <= most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
