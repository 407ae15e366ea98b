"""Cancel and replace: a newer request of a repository ends the older one's Spark jobs, whose rows never appear.

Each request runs in its own thread under a job tag. Its rows go to a folder of its
own and count once a row in the `published` table names it, which is written while the
request is known to be the repository's active one. So cancelled, replaced and failed
requests leave nothing that a reader sees, and the last published rows stay.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RUNNING, DONE, CANCELLED, REPLACED, FAILED = "running", "done", "cancelled", "replaced", "failed"


@dataclass
class Run:
    repo_id: str
    request_id: int
    tag: str
    state: str = RUNNING
    error: BaseException | None = None
    streams: list[StreamingQuery] = field(default_factory=list)
    thread: threading.Thread | None = None

    def join(self, timeout: float | None = None) -> str:
        self.thread.join(timeout)
        return self.state


class Runner:
    """Requests of repositories over one session; rows are read by `rows`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.active: dict[str, Run] = {}
        self.lock = threading.RLock()

    def start(self, repo_id: str, request_id: int, work: Callable[[Run], DataFrame]) -> Run | None:
        """Runs work(run) and keeps its rows. An older request of the repository is ended; one that is older than the active request isn't started."""
        run = Run(repo_id, request_id, f"run-{uuid.uuid4().hex}")
        with self.lock:
            old = self.active.get(repo_id)
            if old is not None and old.request_id > request_id:
                return None
            if old is not None:
                self._end(old, REPLACED)
            self.active[repo_id] = run
        run.thread = InheritableThread(target=self._work, args=(run, work), daemon=True)
        run.thread.start()
        return run

    def cancel(self, request_id: int) -> bool:
        """Ends the request if it is active."""
        with self.lock:
            for run in [r for r in self.active.values() if r.request_id == request_id]:
                self._end(run, CANCELLED)
                del self.active[run.repo_id]
                return True
        return False

    def _end(self, run: Run, state: str) -> None:
        if run.state == RUNNING:
            run.state = state
            threading.Thread(target=self._quiet, args=(run,), daemon=True).start()

    def _quiet(self, run: Run) -> None:
        """Cancels until the run's thread has ended: a job may be on its way to Spark when the first call comes."""
        while run.thread is None or run.thread.is_alive():
            for q in run.streams:
                q.stop()
            self.spark.sparkContext.cancelJobsWithTag(run.tag)
            time.sleep(0.2)

    def _work(self, run: Run, work: Callable[[Run], DataFrame]) -> None:
        context = self.spark.sparkContext
        context.addJobTag(run.tag)
        try:
            df = work(run)
            if run.state == RUNNING:
                df.write.mode("overwrite").parquet(f"{self.path}/rows/{run.tag}")
            with self.lock:  # a newer request waits here, so what is published was active
                if run.state == RUNNING:
                    told = self.spark.createDataFrame([(run.repo_id, run.request_id, run.tag)], "repo_id string, request_id long, tag string")
                    told.coalesce(1).write.mode("append").parquet(f"{self.path}/published")
                    run.state = DONE
        except Exception as e:
            with self.lock:
                if run.state == RUNNING:
                    run.state, run.error = FAILED, e
        finally:
            context.removeJobTag(run.tag)
            with self.lock:
                if self.active.get(run.repo_id) is run:
                    del self.active[run.repo_id]

    def published(self) -> DataFrame:
        """(repo_id, request_id, tag) of each repository's newest published request."""
        rows = self.spark.read.schema("repo_id string, request_id long, tag string").parquet(f"{self.path}/published")
        return rows.groupBy("repo_id").agg(F.max("request_id").alias("request_id"), F.max_by("tag", "request_id").alias("tag"))

    def rows(self, schema: str) -> DataFrame:
        """The rows of all newest published requests, with repo_id and request_id."""
        marks = self.published()
        files = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/rows").withColumn("tag", F.regexp_extract(F.col("_metadata.file_path"), r"/rows/([^/]+)/", 1))
        return files.join(marks, "tag").drop("tag")
