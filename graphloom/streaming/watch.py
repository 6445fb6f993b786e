"""A watch over changing files: one owner, freshness kept beside the graph, overflow, pending changes
and rebuilds in the background.

What is kept lies in small files of a shared folder, each made by a create or a rename that doesn't
overwrite, so that a driver that dies leaves a state that the next one can go on from.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.change import file_changes
from graphloom.operators.evidence import freshness, worth_increment
from graphloom.storage import drop


class _Folder:
    """Small texts in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._path = path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.at(""))

    def at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def names(self, prefix: str) -> list[str]:
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(self.at(""))) if n.startswith(prefix))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether name was made; False where it is there already."""
        draft = self.at(f"_{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        made = not self.fs.exists(self.at(name)) and self.fs.rename(draft, self.at(name))
        if not made:
            self.fs.delete(draft, False)
        return made


class Lease:
    """The right of one owner to change what a folder stands for, for so many seconds after it was
    taken or renewed. One that ran out is moved away by a rename, which one of several takers
    succeeds in."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 60.0):
        self.folder, self.seconds, self.owner = _Folder(spark, path), seconds, uuid.uuid4().hex

    def _held(self) -> bool:
        if not self.folder.fs.exists(self.folder.at("lease")):
            return False
        return self.folder.fs.getFileStatus(self.folder.at("lease")).getModificationTime() / 1000 + self.seconds > time.time()

    def mine(self) -> bool:
        return self._held() and self.folder.read("lease") == self.owner

    def take(self) -> bool:
        if self.mine():
            return True
        if self._held():
            return False
        lease = self.folder.at("lease")
        if self.folder.fs.exists(lease) and not self.folder.fs.rename(lease, self.folder.at(f"_old-{uuid.uuid4().hex}")):
            return False
        return self.folder.create("lease", self.owner)

    def renew(self) -> None:
        if not self.mine():
            raise RuntimeError("the lease ran out or is another owner's")
        self.folder.fs.setTimes(self.folder.at("lease"), int(time.time() * 1000), -1)

    def free(self) -> None:
        if self.mine():
            self.folder.fs.delete(self.folder.at("lease"), False)


class Freshness:
    """The state of a graph, IDLE at first; each change of it is one more numbered file, and the last
    one counts. It isn't part of the graph, so that a write of that which fails doesn't touch it."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = _Folder(spark, path)

    def history(self) -> list[dict]:
        return [json.loads(self.folder.read(n)) for n in self.folder.names("state-")]

    def now(self) -> str:
        names = self.folder.names("state-")
        return json.loads(self.folder.read(names[-1]))["state"] if names else "IDLE"

    def become(self, then: str, why: str = "") -> None:
        now = self.now()
        if then == now:
            return
        n = len(self.folder.names("state-"))
        if not self.folder.create(f"state-{n:010d}", json.dumps({"state": freshness(now, then), "why": why, "at": time.time()})):
            raise RuntimeError("another owner changed the state at the same time")


def touched(events: DataFrame, cache: DataFrame, present: DataFrame) -> DataFrame:
    """(source_file, change) by hash, of the files that events (path, kind) name. Where one of them is
    an OVERFLOW, events were lost, and all files are compared."""
    if not events.where("kind = 'OVERFLOW'").isEmpty():
        return file_changes(cache, present, verify=True).where("change <> 'same'")
    paths = events.select(events.path.alias("source_file")).distinct()
    own = lambda df: df.join(paths, "source_file", "left_semi")
    return file_changes(own(cache), own(present), verify=True).where("change <> 'same'")


class Watch:
    """Applies batches of events to a graph.

    present() and cache() give the files as they are and as the graph has them; apply(changes) redoes
    some files; rebuild() redoes all, in the background, and publishes the result itself, in one step.
    A batch whose changes fail attempts times is kept, and comes again with the next one; so are
    events that come while a rebuild runs.
    """

    def __init__(self, spark: SparkSession, path: str, present: Callable[[], DataFrame], cache: Callable[[], DataFrame], apply: Callable[[DataFrame], None], rebuild: Callable[[], None], attempts: int = 3, delay: float = 0.1, cap: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.present, self.cache, self.apply, self.rebuild = present, cache, apply, rebuild
        self.attempts, self.delay, self.cap = attempts, delay, cap
        self.state, self.pending = Freshness(spark, f"{self.path}/state"), _Folder(spark, f"{self.path}/pending")
        self._worker, self._running = ThreadPoolExecutor(1), None

    def step(self, events: DataFrame) -> str:
        """Folds in one batch of events (path, kind) and gives the state after it."""
        if self._running is not None and not self._running.done():
            self._keep(events)
            return "REBUILDING"
        self.settle()
        kept = self.pending.names("batch-")
        for name in kept:
            events = events.select("path", "kind").unionByName(self.spark.read.parquet(f"{self.pending.path}/{name}"))
        changes = touched(events, self.cache(), self.present())
        n = changes.count()
        if n and worth_increment(n, self.present().count(), cap=self.cap):
            self.state.become("INCREMENTAL")
            if not self._tried(lambda: self.apply(changes)):
                self._keep(events)
                self._forget(kept)
                self.state.become("FAILED", "the changes are pending")
                return "FAILED"
            self.state.become("IDLE")
        elif n:
            self.state.become("REBUILDING", f"{n} files")
            self._running = self._worker.submit(self._tried, self.rebuild)
        self._forget(kept)
        return self.state.now()

    def settle(self, wait: bool = False) -> None:
        """Takes note of a rebuild that has ended, or waits for it."""
        run: Future | None = self._running
        if run is None or not (wait or run.done()):
            return
        self._running = None
        self.state.become("IDLE" if run.result() else "FAILED", "rebuild")

    def _tried(self, work: Callable[[], None]) -> bool:
        for k in range(self.attempts):
            try:
                work()
                return True
            except Exception:
                if k < self.attempts - 1:
                    time.sleep(max(0.1, self.delay))
        return False

    def _keep(self, events: DataFrame) -> None:
        events.select("path", "kind").write.parquet(f"{self.pending.path}/batch-{time.time_ns():020d}")

    def _forget(self, names: list[str]) -> None:
        for name in names:
            drop(self.spark, f"{self.pending.path}/{name}")
