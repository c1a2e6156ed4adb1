import glob
import os
import subprocess
import sys
import textwrap

import pytest

from millrace.session import new_folder, read_text, scratch, shared_folder, write_text


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    """Stands in for a session that names no shared folder."""

    def __init__(self, master):
        self.sparkContext, self.conf = Context(master), self

    def get(self, key, default):
        return default


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session("yarn"))


def test_a_local_session_may_use_a_temporary_folder():
    session = Session("local[2]")
    assert os.path.isdir(shared_folder(session))
    assert shared_folder(session) == shared_folder(session)


def test_the_named_folder_is_used(spark):
    assert new_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_working_folders_go_with_the_session(tmp_path):
    script = f"""
        from millrace.session import build_session, new_folder
        spark = build_session("t", "local[1]", **{{
            "spark.ui.enabled": "false", "spark.checkpoint.dir": "{tmp_path}"}})
        path = new_folder(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
        spark.stop()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(script)], check=True, timeout=120)
    assert glob.glob(f"{tmp_path}/millrace/*") == []


def test_command_line(spark, tmp_path):
    """ingest --once, then report, as spark-submit would run them."""
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text(
        "event_id,user_id,product_id,product_name,category,price,event_type,timestamp\n"
        "a,u,p,n,c,1.50,view,2026-01-15 10:00:00\n"
    )

    def call(*args):
        return subprocess.run(
            [sys.executable, "-m", "millrace", *args],
            check=True, timeout=300, capture_output=True, text=True,
        ).stdout

    names = ("landing", "quarantine", "ledger", "checkpoint", "table")
    folders = [f"--{n}={tmp_path / n}" for n in names]
    call("ingest", "--once", *folders)
    shown = call("report", folders[-1], "--view=v_event_summary")
    assert "|view      |1           |1           |1.50     |1.50       |" in shown


def test_scratch_folders_are_removed_but_for_what_is_read(spark):
    with scratch(spark) as noted:
        paths = [new_folder(spark, "x") for _ in range(3)]
        for path in paths:
            spark.range(3).write.parquet(path)
    later = new_folder(spark, "x")
    kept = spark.read.parquet(paths[1])
    noted.remove(but=kept)
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [False, True, False]
    assert kept.count() == 3 and later.rsplit("/", 1)[0] not in noted.folders
    noted.remove()
    assert not os.path.exists(paths[1].removeprefix("file:"))


def test_small_files_are_whole_and_replaced(spark, tmp_path):
    for text in ("first é", "second"):
        write_text(spark, f"{tmp_path}/a/b.json", text)
        assert read_text(spark, f"{tmp_path}/a/b.json") == text
    assert [f for f in os.listdir(tmp_path / "a") if not f.startswith(".")] == ["b.json"]
