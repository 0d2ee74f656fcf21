"""The text store: whole commits, changed and vanished files, bounded folders."""

import os
import shutil

import pytest

from tomewright.sources.files import chapter_files, index_files, raw_files
from tomewright.streaming import store as S


def put(root, drop, book, n, text):
    folder = root / "land" / drop / book
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"第{n}章.txt").write_text(text, encoding="utf-8")


def state(store):
    return ({(r.book_id, r.name, r.text) for r in store.text().collect()},
            {(r.book_id, r.idx, r.title, r.file) for r in store.index().collect()})


def test_three_batches_equal_the_files(spark, tmp_path):
    store = S.TextStore(spark, str(tmp_path / "store"), most=2)

    def run():
        S.store_stream(spark, str(tmp_path / "land"), store, str(tmp_path / "cp"), trust_utf8=True).trigger(availableNow=True).start().awaitTermination()
    for n in (1, 2, 10):
        put(tmp_path, "d1", "甲", n, f"第{n}章\n旧文{n}")
    put(tmp_path, "d1", "乙", 1, "only")
    run()
    before = state(store)
    assert {i[:2] for i in before[1]} == {("甲", 1), ("甲", 2), ("甲", 3), ("乙", 1)}
    put(tmp_path, "d2", "甲", 2, "第2章\n新文")
    put(tmp_path, "d2", "丙", 5, "")
    os.remove(tmp_path / "land" / "d1" / "甲" / "第1章.txt")
    shutil.move(tmp_path / "land" / "d1" / "乙", tmp_path / "kept")          # a whole book vanishes
    run()
    put(tmp_path, "d3", "甲", 3, "第3章\n又")
    run()
    text, index = state(store)
    os.remove(tmp_path / "land" / "d1" / "甲" / "第2章.txt")                  # the older version of a changed chapter
    files = chapter_files(spark, str(tmp_path / "land"), trust_utf8=True)
    assert text == {(r.book_id, r.name, r.text) for r in files.collect()}
    assert index == {(r.book_id, r.idx, r.title, r.file) for r in index_files(files).collect()}
    run()                                                                   # nothing new
    assert state(store) == (text, index) and len(os.listdir(tmp_path / "store" / "data")) <= 4


def test_a_failed_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    store = S.TextStore(spark, str(tmp_path / "store"))
    assert store.text().collect() == [] and store.index().collect() == []
    put(tmp_path, "d1", "甲", 1, "一")
    files = raw_files(spark, str(tmp_path / "land"))
    assert store.commit(files, files.select("path"), "s", 0, trust_utf8=True)
    was, folders = state(store), sorted(os.listdir(tmp_path / "store" / "data"))
    assert not store.commit(files, None, "s", 0) and state(store) == was      # the same batch again
    put(tmp_path, "d1", "甲", 2, "二")
    with monkeypatch.context() as m:
        m.setattr(S, "index_files", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit(raw_files(spark, str(tmp_path / "land")), None, "s", 1)
    assert state(store) == was and sorted(os.listdir(tmp_path / "store" / "data")) == folders
    other = S.TextStore(spark, str(tmp_path / "store"))
    with monkeypatch.context() as m:                                          # a writer that has read an older manifest
        m.setattr(other, "manifest", lambda: {"version": 0, "parts": [], "done": {}})
        with pytest.raises(RuntimeError):
            other.commit(files)
    assert state(store) == was


def test_folders_stay_bounded(spark, tmp_path):
    store = S.TextStore(spark, str(tmp_path / "store"), most=3, keep=1)
    for n in range(1, 8):
        put(tmp_path, f"d{n}", "甲", n % 4, f"文{n}")
        store.commit(raw_files(spark, str(tmp_path / "land" / f"d{n}")), None, "s", n, trust_utf8=True)
        assert len(os.listdir(tmp_path / "store" / "data")) <= 4
    assert {t[1:] for t in state(store)[0]} == {("第0章.txt", "文4"), ("第1章.txt", "文5"), ("第2章.txt", "文6"), ("第3章.txt", "文7")}
