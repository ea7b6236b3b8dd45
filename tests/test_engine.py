"""The index end to end, on small trees of files."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.settings import Settings
from tessera.sources import scan
from tessera.sources.snapshot import Locked, NotQueryable, SnapshotStore

AUTH = '''import os
from app.db import connect


class SessionManager:
    """Keeps sessions."""

    def refresh(self, token):
        # renews
        return validate_token(token)


def validate_token(token):
    """Checks a token."""
    return os.path.exists(token) and self.check(token)
'''


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    (root / "src").mkdir()
    (root / "node_modules").mkdir()
    (root / "src/auth.py").write_text(AUTH)
    (root / "README.md").write_text("# Title\n\nSome words about sessions.\n\n## Usage\n\n" + "word " * 400)
    (root / ".env").write_text("SECRET=1")
    (root / "private.pem").write_text("key")
    (root / "src/data.txt").write_bytes(b"\x00\x01\x02")
    (root / "node_modules/x.js").write_text("function x() {}")
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        from tessera.engine import hash_embedder

        calls.add(len(texts))
        return hash_embedder(16)(texts)

    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", [str(tree)], Settings(), embed, 16)
    e.calls = calls
    e.first = e.reindex()
    return e


def test_scan_leaves_out_secrets_vendored_and_binary_files(spark, tree, engine):
    listed = {r.path for r in scan.list_files(spark, [str(tree)]).collect()}
    assert listed == {"src/auth.py", "README.md", "src/data.txt"}
    assert {r.path for r in engine._tables()["docs"].collect()} == {"src/auth.py", "README.md"}


def test_symbols_references_and_chunks(engine):
    t = engine._tables()
    names = {(r.name, r.kind, r.line_start) for r in t["symbols"].collect()}
    assert names == {("SessionManager", "class", 5), ("refresh", "function", 8), ("validate_token", "function", 13)}
    own = {r.name: r for r in t["symbols"].collect()}
    assert own["validate_token"].docstring == "Checks a token." and own["refresh"].docstring == "renews"
    assert own["refresh"].signature == "def refresh(self, token):"
    refs = {(r.target_name, r.ref_kind, r.line) for r in t["refs"].collect()}
    assert refs == {("os", "import", 1), ("connect", "import", 2), ("validate_token", "call", 10), ("exists", "call", 15), ("check", "call", 15)}
    call = t["refs"].where("target_name = 'validate_token'").first()
    assert call.source_symbol_id == own["refresh"].id
    kinds = [r.chunk_type for r in t["chunks"].where("path = 'src/auth.py'").orderBy("ord").collect()]
    assert kinds == ["imports", "symbol", "symbol", "symbol"]


def test_searches(engine):
    top = engine.code_search("validate_token").first()
    assert top.symbol_name == "validate_token"
    assert engine.code_search("words about sessions", mode="keyword").first().path == "README.md"
    assert engine.code_search("def refresh", mode="semantic").count() > 0
    assert engine.find_symbol("validate_token").first().score >= 100
    assert engine.references("validate_token").first().line == 10
    assert [r.caller for r in engine.neighbors("validate_token")["callers"].collect()] == ["refresh"]
    assert engine.repo_map().count() == 2
    with pytest.raises(ValueError):
        engine.code_search("x", mode="none")


def test_fetch_gives_context(engine):
    chunk = engine._tables()["chunks"].where("ord = 1 and path = 'src/auth.py'").first()
    got = engine.fetch(f"rag://{chunk.doc_id}#chunk={chunk.id}", context=1)
    assert [c["ord"] for c in got["context"]] == [0, 1, 2]
    with pytest.raises(KeyError):
        engine.fetch("symbol://nothing")


def test_tools_and_server(engine):
    import io
    import json

    from tessera.tools import Tools, serve

    tools = Tools(engine)
    assert len(tools.names()) == 17
    assert tools.call("code_search", {"query": "validate_token"})["results"][0]["symbol_name"] == "validate_token"
    assert engine.search("validate_token") is not engine.search("validate_token") and engine.search("validate_token") == engine.search("validate_token")
    assert tools.code_references("validate_token")["references"] and tools.code_references("no sessions")["mentions"]
    assert tools.rag_reindex() == {"ok": False, "error": "changing the index is not allowed by the settings"}
    assert tools.rag_doctor()["ok"] and tools.rag_warmup()["ok"]
    assert tools.document_search("sessions", mode="keyword") == {"results": []}
    with pytest.raises(KeyError):
        tools.document_outline("none.pdf")
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "rag_status"}}, {"id": 4, "method": "nothing"}]
    out = io.StringIO()
    serve(engine, io.StringIO("\n".join(map(json.dumps, asked))), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, 4] and len(answers[1]["result"]["tools"]) == 17 and "error" in answers[3]


def test_updates_keep_ids_and_vectors(engine, tree):
    before = {r.name: r.id for r in engine._tables()["symbols"].collect()}
    chunk_ids = {r.id for r in engine._tables()["chunks"].where("chunk_type = 'symbol'").collect()}
    made = engine.calls.value
    again = engine.reindex()
    assert again["chunks"] == engine.first["chunks"] and engine.calls.value == made
    (tree / "src/auth.py").write_text("# a new first line\n" + AUTH)
    os.remove(tree / "README.md")
    engine.reindex()
    t = engine._tables()
    assert {r.name: r.id for r in t["symbols"].collect()} == before
    assert {r.id for r in t["chunks"].where("chunk_type = 'symbol'").collect()} == chunk_ids
    assert t["docs"].count() == 1
    assert engine.doctor()["ok"]


def test_failed_run_keeps_the_last_snapshot(spark, engine):
    version = engine.store.version()
    with pytest.raises(RuntimeError, match="boom"), engine.store.writing():
        raise RuntimeError("boom")
    assert engine.store.version() == version
    with pytest.raises(NotQueryable):
        engine.store.check()
    engine.reindex()
    assert engine.store.check() == version  # nothing had changed, so nothing was written


def test_updates_write_only_their_buckets_and_other_settings_rebuild(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    for root in (one, two):
        root.mkdir()
    for i in range(40):
        (one / f"m{i}.py").write_text(f"def function_{i}(value):\n    return value + {i}\n")
    e = Engine(spark, f"file://{tmp_path}/store", [str(one), str(two)], Settings(), dim=8)
    e.reindex()
    before = e.store.current()["tables"]
    (one / "m7.py").write_text("def changed_7(value):\n    return function_7(value)\n")
    assert e.reindex(paths=["m7.py"])["docs"] == 40
    after = e.store.current()["tables"]
    assert all(len([b for b, v in after[t]["buckets"].items() if before[t]["buckets"].get(b) != v]) <= 1 for t in after)
    assert {r.name for r in e._tables()["symbols"].where("path = 'm7.py'").collect()} == {"changed_7"} and e.code_search("changed_7").first().path == "m7.py"
    # the same relative path, time and size under the other root is another file
    stat = (one / "m3.py").stat()
    (two / "m3.py").write_text((one / "m3.py").read_text())
    os.utime(two / "m3.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert e.reindex()["docs"] == 41
    other = Engine(spark, f"file://{tmp_path}/store", [str(one), str(two)], Settings(embedding_dim=4), dim=4)
    other.reindex(paths=["m7.py"])
    assert {len(r.vector) for r in other._tables()["vectors"].collect()} == {4} and other._tables()["docs"].count() == 41 and other.doctor()["ok"]
    assert other.optimise()["ok"] and other.code_search("changed_7").first().path == "m7.py"
    assert len(list((tmp_path / "store/manifests").glob("*.json"))) == 1


def test_word_search_reads_the_terms_rows_only(engine):
    plan = engine.code_search("validate_token", mode="keyword")._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "FileScan parquet" in x and "positions" in x)
    assert "PushedFilters" in scan and "In(term" in scan and "regexp_extract_all" not in plan


def test_crash_between_writing_and_renaming_keeps_the_pointer(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    store._write("CURRENT.json", {"version": 1})
    store._create("CURRENT.json.new", {"version": 2}, True)  # where a writer dies
    assert store.version() == 1
    store._write("CURRENT.json", {"version": 3})
    assert store.version() == 3


def test_lock_of_a_dead_writer_is_taken_over(spark, tmp_path):
    import socket

    store = SnapshotStore(spark, f"file://{tmp_path}")
    store._create("WRITER.lock", {"host": socket.gethostname(), "pid": 2**30}, False)
    with store.writing():
        pass
    store._create("WRITER.lock", {"host": "elsewhere", "pid": 1}, False)
    with pytest.raises(Locked), store.writing():
        pass


def test_second_writer_is_refused(spark, tmp_path):
    a, b = (SnapshotStore(spark, f"file://{tmp_path}") for _ in range(2))
    with a.writing(), pytest.raises(Locked), b.writing():
        pass
    with pytest.raises(NotQueryable):
        a.check()


def test_many_files_are_joined_and_odd_names_opened(spark, tmp_path, monkeypatch):
    (tmp_path / "a [1]{x}.md").write_text("one")
    (tmp_path / "b c.txt").write_text("two\r\nlines")
    files = scan.list_files(spark, [str(tmp_path)])
    named = {(r.path, r.text) for r in scan.read_documents(spark, files, [str(tmp_path)]).collect()}
    monkeypatch.setattr(scan, "NAMED_FILES", 1)
    joined = {(r.path, r.text) for r in scan.read_documents(spark, files, [str(tmp_path)]).collect()}
    assert named == joined == {("a [1]{x}.md", "one"), ("b c.txt", "two\nlines")}
    assert scan.read_documents(spark, files.limit(0), [str(tmp_path)]).count() == 0


def test_git_listing_follows_the_ignore_rules(spark, tmp_path):
    import subprocess

    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("skip.py\n")
    for name in ("skip.py", "take.py", "id_rsa"):
        (tmp_path / name).write_text("x = 1")
    assert {r.path for r in scan.git_files(spark, str(tmp_path)).collect()} == {"take.py"}


def test_targets(tree, tmp_path):
    got = scan.resolve_targets([str(tree)], ["src/auth.py", "src", "gone.py", "/etc/passwd"])
    assert [p.removeprefix(os.path.realpath(tree) + "/") for p in got.files] == ["src/auth.py"] and len(got.directories) == 1 and len(got.missing) == 1 and got.rejected == ["/etc/passwd"]
    with pytest.raises(ValueError):
        scan.resolve_targets([str(tree)], ["x"] * 300)


def test_settings():
    with pytest.raises(ValueError):
        Settings(max_top_k=4)
    with pytest.raises(ValueError):
        Settings(chunk_tokens=0)
    assert Settings.from_env({"TESSERA_DEFAULT_TOP_K": "5", "TESSERA_READ_ONLY": "no"}) == Settings(default_top_k=5, read_only=False)
    assert Settings().fingerprint() != Settings(chunk_tokens=100).fingerprint() and Settings().fingerprint() == Settings(rrf_k=10).fingerprint()
    assert [Settings().top_k(k) for k in (None, 1, 99)] == [8, 1, 32]


def test_stream_merges_into_the_index(spark, tmp_path):
    from tessera.streaming.arrivals import merge_stream

    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int").coalesce(1).write.parquet(source)
    for v in (1, 2):
        if v == 2:
            spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int").coalesce(1).write.mode("append").parquet(source)
        merge_stream(spark.readStream.schema("id string, v int").parquet(source), store, "items", "id", f"{tmp_path}/ck").awaitTermination()
    assert {(r.id, r.v) for r in store.table("items").collect()} == {("a", 1), ("b", 2), ("c", 2)}
    spark.createDataFrame([("a", 5), ("a", 9), ("a", 7)], "id string, v int").coalesce(1).write.mode("append").parquet(source)
    merge_stream(spark.readStream.schema("id string, v int").parquet(source), store, "items", "id", f"{tmp_path}/ck", order="v").awaitTermination()
    assert {(r.id, r.v) for r in store.table("items").collect()} == {("a", 9), ("b", 2), ("c", 2)}


def test_windows_on_a_table(spark):
    from tessera.streaming.arrivals import windowed_counts

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double")
    got = windowed_counts(rows.withColumn("ts", F.to_timestamp("ts"))).orderBy("start").collect()
    assert [(r.n, r.total) for r in got] == [(2, 3.0), (1, 4.0)]
