"""Third round: folders are listed and read by tasks, a stream keeps its paths in a table."""

import os

import pytest

from tomewright.sources import files as S
from tomewright.streaming import store as St


def land(root, names):
    for n, text in names.items():
        os.makedirs((root / n).parent, exist_ok=True)
        (root / n).write_text(text, encoding="utf-8")


def test_listing_equals_sparks(spark, tmp_path):
    land(tmp_path, {"a/b/第1章.txt": "一", "a/b/x.md": "", "a/_no/第2章.txt": "2", "a/.no/第2章.txt": "2", "a/_k=1/第3章.txt": "3", "top.txt": "t", "a/_SUCCESS": "",
                    "%20 é/第4章.bin": "\x00"})
    want = {(r.path.replace("file:", ""), r.modificationTime.replace(microsecond=0), r.length, bytes(r.content)) for r in S.raw_files(spark, str(tmp_path)).collect()}
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = S.read_files(S.list_files(spark, root)).collect()
        assert {(r.path.replace("file://", ""), r.modificationTime.replace(microsecond=0), r.length, bytes(r.content)) for r in got} == want and len(got) == len(want) == 4
    with pytest.raises(FileNotFoundError):
        S.list_files(spark, str(tmp_path / "none"))


def test_the_driver_lists_no_chapter(spark, tmp_path, monkeypatch):
    land(tmp_path / "land", {f"d/甲/第{i}章.txt": f"第{i}章\n文" for i in range(1, 9)})
    monkeypatch.setattr(S, "raw_files", lambda *_: 1 / 0)
    assert S.chapter_files(spark, str(tmp_path / "land"), trust_utf8=True).count() == 8
    store = St.TextStore(spark, str(tmp_path / "store"))

    def run():
        q = St.store_stream(spark, str(tmp_path / "land"), store, str(tmp_path / "cp"), trust_utf8=True).trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress["sources"][0]["description"]
    assert "FileStream" not in run() and store.text().count() == 8
    was = store.manifest()
    run()
    assert store.manifest() == was                  # nothing new, nothing committed


def test_a_repeated_batch_takes_the_same_files(spark, tmp_path, monkeypatch):
    """A batch that failed in its commit takes what it had listed; what came meanwhile waits for the next."""
    land(tmp_path / "land", {"d/甲/第1章.txt": "一"})
    store = St.TextStore(spark, str(tmp_path / "store"))
    stream = lambda: St.store_stream(spark, str(tmp_path / "land"), store, str(tmp_path / "cp"), trust_utf8=True).trigger(availableNow=True).start().awaitTermination()
    with monkeypatch.context() as m:
        m.setattr(St, "index_files", lambda *_: 1 / 0)
        with pytest.raises(Exception):
            stream()
    land(tmp_path / "land", {"e/甲/第2章.txt": "二"})
    stream()
    assert {r.name for r in store.text().collect()} >= {"第1章.txt"}
    stream()
    assert {r.name for r in store.text().collect()} == {"第1章.txt", "第2章.txt"}
