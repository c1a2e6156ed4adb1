"""Which event ids a stored table holds, so that a batch reads only where its ids may be."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from millrace.session import existing, filesystem, remove_folders

SCHEMA = "hash bigint, event_id string"
# Ids of a batch that are looked up one by one inside the files; more choose whole files.
LOOKUPS = 512
# Rows of a Parquet page: what is read at least where one id may be.
PAGE_ROWS = 256
# A run has more than 2 to this power of files only if they would hold over FILE_IDS ids each.
MOST_BITS = 6
FILE_IDS = 1 << 18


def keyed(events):
    return events.select(F.xxhash64("event_id").alias("hash"), "event_id")


def _bucket(hash_, bits):
    return F.shiftrightunsigned(hash_, 64 - bits) if bits else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class IdIndex:
    """Runs of ids sorted by hash, each split into files by the first bits of the hash.

    The number of bits follows from the ids of a run and stands in its folder's name, so each run
    is read as it was written, whatever ids_per_file is now; merge() splits anew. Files below
    FILE_IDS do not grow in number with the table: pages lead to single ids, and more ids than are
    looked up that way fall into all of them. A batch opens
    only the files that its own hashes fall into, and of these, if it has few ids, the pages:
    small pages and their statistics lead to single hashes. The ids themselves are compared, the
    hash only finds them. Repeated ids do no harm, so new files are complete before old ones go.
    """

    path: str
    ids_per_file: int = 1 << 18

    def write(self, ids, name):
        """Write ids (hash, event_id) as the run of a name, replacing what broke off before."""
        bits = self._bits(ids.count())
        remove_folders(ids.sparkSession, f"{self.path}/run={name}")
        (
            ids.withColumn("bucket", _bucket(F.col("hash"), bits))
            .repartition("bucket").sortWithinPartitions("bucket", "hash")
            .write.option("parquet.page.row.count.limit", PAGE_ROWS)
            .partitionBy("bucket").parquet(f"{self.path}/run={name}/bits={bits}")
        )

    def _bits(self, rows):
        wanted = (rows // self.ids_per_file).bit_length()
        return min(wanted, max(MOST_BITS, (rows // FILE_IDS).bit_length()))

    def read(self, spark, names):
        """All ids of some runs."""
        folders = [f for folders in self._files(spark, names).values() for f in folders.values()]
        return _read(spark, folders)

    def merge(self, spark, names, name):
        """One run of several."""
        self.write(self.read(spark, names).distinct(), name)

    def remove(self, spark, name):
        remove_folders(spark, f"{self.path}/run={name}")

    def _files(self, spark, names):
        """{(run, bits): {bucket: folder}} of some runs."""
        fs, pattern = filesystem(spark, f"{self.path}/run=*/bits=*")
        found = {}
        for status in fs.globStatus(pattern) or []:
            place = status.getPath()
            run = place.getParent().getName().removeprefix("run=")
            if run in names:
                bits = int(place.getName().removeprefix("bits="))
                found[run, bits] = {
                    int(f.getPath().getName().removeprefix("bucket=")): f.getPath().toString()
                    for f in fs.listStatus(place) if f.isDirectory()}
        return found

    def near(self, events, names, rows=None):
        """The ids of some runs among which those of the events must be, if they are there.

        rows is the number of events, if it is known.
        """
        spark = events.sparkSession
        files = self._files(spark, set(names))
        if not files:
            return spark.createDataFrame([], SCHEMA)
        hashes = keyed(events).select("hash")
        rows = hashes.count() if rows is None else rows
        most = max(bits for _, bits in files)
        few = rows <= LOOKUPS
        if few:
            own = [r["hash"] for r in hashes.collect()]
            first = {(h % (1 << 64)) >> (64 - most) if most else 0 for h in own}
        else:  # at most as many numbers as there are files
            first = {r[0] for r in hashes.select(_bucket(F.col("hash"), most)).distinct().collect()}
        folders = []
        for (_, bits), buckets in files.items():
            wanted = {b >> (most - bits) for b in first}
            folders += [buckets[b] for b in sorted(wanted & buckets.keys())]
        found = _read(spark, folders)
        if few and own:
            found = found.where(" OR ".join(f"hash = bigint('{h}')" for h in sorted(own)))
        return found


def _read(spark, folders):
    folders = existing(spark, folders) if len(folders) < 64 else folders
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*folders)
