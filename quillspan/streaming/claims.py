"""One queue, several workers: each row is worked on once, by whoever holds the lease of its bucket.

Rows fall into a fixed number of buckets by the hash of their key. A lease is a file that only one worker can create; it
runs out, and is then taken over by renaming it, which also succeeds for one worker alone. A worker does its buckets' rows
of each micro-batch; of a bucket that it has just taken, all that came before and isn't done.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Leases:
    """Leases of buckets, as files in a folder that all workers share."""

    def __init__(self, spark: SparkSession, path: str, worker: str, seconds: float, clock: Callable[[], float] = time.time) -> None:
        self.jvm, self.path, self.worker, self.seconds, self.clock = spark._jvm, path.rstrip("/"), worker, seconds, clock
        self.folder = self._path(self.path)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.folder)

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _create(self, bucket: int) -> bool:
        """Make the lease's file, which only one worker can; then say whose it is and until when."""
        target = self._path(f"{self.path}/{bucket:05d}")
        try:
            self.files.create(target, False).close()  # fails if another has it
        except Exception as e:  # noqa: BLE001
            if "exist" not in str(e).lower():
                raise
            return False
        self._tell(bucket)
        return True

    def _tell(self, bucket: int) -> None:
        """Write the owner and end of a lease, in the name of a file beside it: it is there whole or not at all. Older ones go."""
        end = int((self.clock() + self.seconds) * 1000)
        older = self._ends(bucket)
        self.files.create(self._path(f"{self.path}/{bucket:05d}.{end:015d}.{self.worker}"), True).close()
        for _, _, name in older:
            if name != f"{bucket:05d}.{end:015d}.{self.worker}":
                self.files.delete(self._path(f"{self.path}/{name}"), False)

    def _ends(self, bucket: int) -> list[tuple[int, str, str]]:
        found = self.files.globStatus(self._path(f"{self.path}/{bucket:05d}.*.*")) or []
        out = []
        for status in found:
            name = status.getPath().getName()
            _, end, worker = name.split(".", 2)
            out.append((int(end), worker, name))
        return sorted(out)

    def take(self, bucket: int) -> bool:
        """Hold a bucket's lease for the next while: renew an own one, make a new one, or take one that has run out."""
        if self._create(bucket):
            return True
        ends = self._ends(bucket)
        now = self.clock() * 1000
        if ends and ends[-1][1] == self.worker and ends[-1][0] > now:
            self._tell(bucket)
            return True
        if self._over(bucket, ends, now):
            gone = self._path(f"{self.path}/_gone-{bucket:05d}-{uuid.uuid4().hex}")
            try:
                moved = self.files.rename(self._path(f"{self.path}/{bucket:05d}"), gone)  # for one worker alone
            except Exception:  # noqa: BLE001  another was faster
                return False
            if moved:
                self.files.delete(gone, False)
                return self._create(bucket)
        return False

    def _over(self, bucket: int, ends: list[tuple[int, str, str]], now: float) -> bool:
        """Has a lease run out? One whose owner stopped before it said until when lasts from its file's time."""
        if ends:
            return ends[-1][0] <= now
        found = self.files.globStatus(self._path(f"{self.path}/{bucket:05d}")) or []
        return any(s.getModificationTime() + self.seconds * 1000 <= time.time() * 1000 for s in found)

    def mine(self, bucket: int) -> bool:
        ends = self._ends(bucket)
        return bool(ends) and ends[-1][1] == self.worker and ends[-1][0] > self.clock() * 1000

    def release(self, bucket: int) -> None:
        """Give a lease back at once."""
        for _, worker, name in self._ends(bucket):
            if worker == self.worker:
                self.files.delete(self._path(f"{self.path}/{name}"), False)
                self.files.delete(self._path(f"{self.path}/{bucket:05d}"), False)


class Worker:
    """Works through a queue beside others. process makes the results, one row for each row, from rows it gets.

    queue: reads the whole queue, with the key, as it is now; most: buckets that this worker holds at once.
    """

    def __init__(
        self, spark: SparkSession, path: str, name: str, key: str, process: Callable[[DataFrame], DataFrame], queue: Callable[[], DataFrame], result: str,
        buckets: int = BUCKETS, most: int = BUCKETS, seconds: float = 60.0, clock: Callable[[], float] = time.time,
    ) -> None:
        self.spark, self.path, self.name, self.key, self.process, self.queue, self.result = spark, path.rstrip("/"), name, key, process, queue, result
        self.leases, self.buckets, self.most, self.held = Leases(spark, f"{self.path}/leases", name, seconds, clock), buckets, most, set()

    def hold(self) -> set[int]:
        """Renew what is held, and take more up to most; starts at a place of its own, so that workers seldom meet."""
        kept = {b for b in sorted(self.held) if self.leases.take(b)}
        start = sum(self.name.encode()) * 7919 % self.buckets
        for i in range(self.buckets):
            b = (start + i) % self.buckets
            if len(kept) >= self.most:
                break
            if b not in kept and self.leases.take(b):
                kept.add(b)
        return kept

    def done(self) -> DataFrame:
        """Results of all workers: those of batches that were written to their end."""
        files = self.leases.files
        found = files.globStatus(self.leases._path(f"{self.path}/done/*/_SUCCESS")) or []
        folders = [s.getPath().getParent().toString() for s in found]
        return self.spark.read.schema(self.result).parquet(*folders) if folders else self.spark.createDataFrame([], self.result)

    def __call__(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch. A batch that comes again does nothing that was done."""
        target = f"{self.path}/done/{self.name}-{number:012d}"
        if self.leases.files.exists(self.leases._path(f"{target}/_SUCCESS")):
            return
        held = self.hold()
        fresh, self.held = held - self.held, held
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
        rows = batch.filter(bucket.isin(sorted(held - fresh)))
        if fresh:
            rows = rows.unionByName(self.queue().select(*batch.columns).filter(bucket.isin(sorted(fresh))))
        todo = rows.dropDuplicates([self.key]).join(self.done().select(self.key), self.key, "left_anti")
        staged = f"{self.path}/staged/{self.name}-{number:012d}"
        self.process(todo).write.mode("overwrite").parquet(staged)
        lost = sorted(b for b in held if not self.leases.mine(b))  # the work took longer than the lease
        if lost:
            self.held -= set(lost)
            self.spark.read.schema(self.result).parquet(staged).filter(~bucket.isin(lost)).write.mode("overwrite").parquet(target)
            return
        done = self.leases._path(target)
        self.leases.files.mkdirs(done.getParent())
        self.leases.files.delete(done, True)  # what a stopped attempt has left, without its mark of success
        self.leases.files.rename(self.leases._path(staged), done)

    def stop(self) -> None:
        for b in self.held:
            self.leases.release(b)
        self.held = set()
