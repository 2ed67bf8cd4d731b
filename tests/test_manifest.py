"""Which files a run opens: new, changed, touched, gone, and names that look like patterns."""

import os

import pytest

from colloquy.sources.manifest import FileManifest, literal


def put(folder, name, text, at):
    path = folder / name
    path.write_text(text)
    os.utime(path, (at, at))


def statuses(changes):
    return {r["file_name"]: r["status"] for r in changes.collect()}


def test_a_rerun_opens_changed_files_only(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a.txt", "b.txt", "c.txt", "d [x]*.txt"):
        put(folder, name, f"=== Dialogue Log ===\nUser: {name}\n", 1000)
    put(folder, "note.md", "x", 1000)
    manifest = FileManifest(spark, str(tmp_path / "m"))
    first = manifest.changes(str(folder))
    assert statuses(first) == dict.fromkeys(["a.txt", "b.txt", "c.txt", "d [x]*.txt"], "new")
    assert manifest.changed_transcripts(first).count() == 4
    manifest.save(first)
    assert set(statuses(manifest.changes(str(folder))).values()) == {"same"}
    put(folder, "a.txt", "User: changed", 1000)
    put(folder, "b.txt", "=== Dialogue Log ===\nUser: b.txt\n", 2000)
    os.remove(folder / "c.txt")
    put(folder, "e.txt", "User: e", 1000)
    second = manifest.changes(str(folder))
    assert statuses(second) == {"a.txt": "changed", "b.txt": "same", "c.txt": "gone", "d [x]*.txt": "same", "e.txt": "new"}
    assert {r["file_name"] for r in manifest.changed_transcripts(second).collect()} == {"a.txt", "e.txt"}
    assert not {"b.txt", "c.txt"} & {r["file_name"] for r in manifest.changed_transcripts(second).collect()}
    manifest.save(second)
    assert statuses(manifest.changes(str(folder))) == dict.fromkeys(["a.txt", "b.txt", "d [x]*.txt", "e.txt"], "same")


def test_an_unsaved_run_starts_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.txt", "User: a", 5)
    manifest = FileManifest(spark, str(tmp_path / "m"))
    for _ in range(2):
        assert statuses(manifest.changes(str(folder))) == {"a.txt": "new"}
    manifest.save(manifest.changes(str(folder)))
    os.remove(folder / "a.txt")
    gone = manifest.changes(str(folder))
    assert statuses(gone) == {"a.txt": "gone"}
    manifest.save(gone)
    assert manifest.entries().count() == 0 and statuses(manifest.changes(str(folder))) == {}


@pytest.mark.parametrize("path", ["/a/b.txt", "/a/[b]?{c}*.txt"])
def test_literal_paths(path):
    assert literal(path).replace("\\", "") == path
