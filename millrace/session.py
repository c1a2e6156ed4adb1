"""Session settings and the shared working folder."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    # Wall-clock columns are zone-free; UTC keeps the remaining instants readable.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.schemaInference": "false",
    # Streaming state may outgrow the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app="millrace", master=None, **conf):
    """A session with the settings above. Set spark.sql.shuffle.partitions here
    before a stateful stream first starts: its checkpoint keeps that number."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark):
    """The folder every executor can reach: spark.checkpoint.dir of the session.

    A temporary folder stands in only for a local master that sets none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder:
        return folder.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


_scratches = []


class Scratch:
    """The folders that new_folder() has given since, to be removed before the session ends."""

    def __init__(self, spark):
        self.spark, self.folders = spark, []

    def remove(self, but=None):
        """Remove them, without those that a frame reads."""
        kept = but.inputFiles() if but is not None else []
        left = [f for f in self.folders if any(f"{f}/" in k for k in kept)]
        for folder in self.folders:
            if folder not in left:
                remove_folders(self.spark, folder)
        self.folders = left


@contextmanager
def scratch(spark):
    """Note the folders that are given meanwhile."""
    noted = Scratch(spark)
    _scratches.append(noted)
    try:
        yield noted
    finally:
        _scratches.remove(noted)


def new_folder(spark, label):
    """A path under the shared folder that nothing else uses, gone with the session."""
    parent = f"{shared_folder(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    fs, target = filesystem(spark, parent)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    for noted in _scratches:
        noted.folders.append(parent)
    return f"{parent}/data"


def filesystem(spark, path):
    """The Hadoop file system of a path and the path itself."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_text(spark, path, text):
    """A small file, there as a whole or not at all."""
    fs, aside = filesystem(spark, f"{path}.{uuid.uuid4().hex}._COPYING_")
    _, target = filesystem(spark, path)
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"cannot write {path}")


def read_text(spark, path):
    fs, target = filesystem(spark, path)
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def ensure_folder(spark, path):
    fs, target = filesystem(spark, path)
    fs.mkdirs(target)


def remove_folders(spark, pattern):
    """Delete the folders that match a path pattern, if any."""
    fs, target = filesystem(spark, pattern)
    for found in fs.globStatus(target) or []:
        fs.delete(found.getPath(), True)


def existing(spark, paths):
    """Those of the paths that exist."""
    located = [(path, *filesystem(spark, path)) for path in paths]
    return [path for path, fs, target in located if fs.exists(target)]
