"""Named jobs: validated, started, listed, aborted, cleaned up and inspected.

A job maps the rows of a source by a handler and applies what it yields: counters are summed, mutations go to a sink.
Spark plans the splits and retries tasks; this layer only keeps the states.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import operations
from millrace.operators.mapper import resolve
from millrace.operators.splits import SHARDS
from millrace.operators.status import ABORTED, ACTIVE, FAILED, SUCCESS, job_status
from millrace.sources.shared import materialise

RATE = 100


@dataclass
class JobSpec:
    """What a job does. params: the source's and handler's; job_params: those of the job itself (done_callback, ...)."""

    name: str
    handler: str
    source: str
    params: dict = field(default_factory=dict)
    job_params: dict = field(default_factory=dict)
    #: Tasks to deal the rows over; by default the source's own partitions, without a shuffle.
    shards: int | None = None
    #: Rows a second over all shards, in force if the job is paced.
    rate: float = RATE
    paced: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> JobSpec:
        return cls(**json.loads(text))

    @classmethod
    def from_form(cls, form: dict) -> JobSpec:
        """From request parameters: name, mapper_input_reader, mapper_handler, mapper_params.*, params.* and mapper_params_validator.

        Parameters given more than once are lists.  A validator may change the parameters, or raise.
        """
        if missing := [k for k in ("name", "mapper_input_reader", "mapper_handler") if not form.get(k)]:
            raise ValueError(f"missing parameters: {', '.join(missing)}")

        def under(prefix: str) -> dict:
            return {k[len(prefix) :]: (v[0] if isinstance(v, list) and len(v) == 1 else v) for k, v in form.items() if k.startswith(prefix)}

        params, job = under("mapper_params."), under("params.")
        for key, values in (("mapper_params_validator", params), ("params_validator", job)):
            if form.get(key):
                resolve(form[key])(values)
        shards, rate = int(params["shard_count"]) if params.get("shard_count") else None, float(params.get("processing_rate", RATE))
        # A job is paced if it names a rate, or asks for quota, and doesn't turn it off.
        paced = str(params.get("enable_quota", "processing_rate" in params)).lower() in ("true", "1", "yes", "on")
        return cls(form["name"], form["mapper_handler"], form["mapper_input_reader"], params, job, shards, rate, paced)


class Hooks:
    """Called around a job. A subclass overrides what it needs."""

    def on_start(self, job_id: str, spec: JobSpec) -> None: ...

    def on_done(self, job_id: str, status: str) -> None: ...


@dataclass
class JobState:
    job_id: str
    spec: JobSpec
    status: str = ACTIVE
    started: float = field(default_factory=time.time)
    updated: float = field(default_factory=time.time)
    counters: dict = field(default_factory=dict)
    shards: list = field(default_factory=list)
    error: str = ""
    abort: bool = False


class Jobs:
    """The jobs of one driver.

    sources: name to function of (spark, params) that gives the rows; sink: what is done with a job's mutations, a function of
    (operations, spec), None to drop them.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, Callable[[SparkSession, dict], DataFrame]], sink: Callable[[DataFrame, JobSpec], None] | None = None, hooks: Hooks | None = None) -> None:
        self.spark, self.sources, self.sink, self.hooks = spark, sources, sink, hooks or Hooks()
        self._jobs: dict[str, JobState] = {}
        self._threads: dict[str, threading.Thread] = {}

    def validate(self, spec: JobSpec) -> None:
        if spec.rate <= 0:
            raise ValueError("rate: more than none")
        if spec.shards is not None and spec.shards < 1:
            raise ValueError("shards: at least one")
        if spec.source not in self.sources:
            raise ValueError(f"no such source: {spec.source}")
        if not callable(resolve(spec.handler)):
            raise ValueError(f"not a handler: {spec.handler}")

    def start(self, spec: JobSpec, delay: float = 0) -> str:
        """Check the spec and run the job in a thread of its own; its id, which is also the tag of its Spark jobs."""
        self.validate(spec)
        rows = self.sources[spec.source](self.spark, spec.params)
        job_id = uuid.uuid4().hex
        state = self._jobs[job_id] = JobState(job_id, spec)
        context = self.spark.sparkContext

        def run() -> None:
            context.addJobTag(job_id)
            context.setInterruptOnCancel(True)
            try:
                if delay:
                    time.sleep(delay)
                self.hooks.on_start(job_id, spec)
                if not state.abort:
                    self._work(state, rows)
                states = [shard["status"] for shard in state.shards]
                state.status = job_status(states, len(states), state.abort)
            except Exception as e:  # noqa: BLE001  a job's failure is its status
                state.status, state.error = (ABORTED if state.abort else FAILED), str(e)[:1000]
            finally:
                state.updated = time.time()
                context.removeJobTag(job_id)
                self._finish(state)

        self._threads[job_id] = InheritableThread(target=run, daemon=True)
        self._threads[job_id].start()
        return job_id

    def _work(self, state: JobState, rows: DataFrame) -> None:
        spec = state.spec
        shards = spec.shards or (SHARDS if spec.paced else None)
        rows = rows.repartition(shards) if shards else rows
        done = materialise(operations.run_handler(rows, spec.handler, spec.params, spec.rate / shards if spec.paced else None))
        counts = done.where("op = 'increment'").groupBy("shard", "name").agg(F.sum("delta").alias("value"))
        per: dict[int, dict] = {}
        for r in counts.collect():  # one row for each shard and counter
            per.setdefault(r["shard"], {})[r["name"]] = r["value"]
            state.counters[r["name"]] = state.counters.get(r["name"], 0) + r["value"]
        state.shards = [{"shard_number": k, "shard_id": f"{state.job_id}-{k}", "processed": v.get(operations.CALLS, 0), "status": SUCCESS, "counters": v} for k, v in sorted(per.items())]
        if self.sink and not state.abort:
            self.sink(done, state.spec)

    def _finish(self, state: JobState) -> None:
        self.hooks.on_done(state.job_id, state.status)
        if callback := state.spec.job_params.get("done_callback"):
            resolve(callback)(state.job_id)

    def wait(self, job_id: str, timeout: float | None = None) -> str:
        self._threads[job_id].join(timeout)
        return self._jobs[job_id].status

    def abort(self, job_id: str) -> None:
        """Stop the job's tasks; a job that has ended stays as it is."""
        state = self._jobs[job_id]
        if state.status == ACTIVE:
            state.abort = True
            self.spark.sparkContext.cancelJobsWithTag(job_id)

    def cleanup(self, job_id: str) -> bool:
        """Forget a job that has ended."""
        if job_id not in self._jobs or self._jobs[job_id].status == ACTIVE:
            return False
        del self._jobs[job_id], self._threads[job_id]
        return True

    def list(self, count: int = 50, cursor: str | None = None) -> tuple[list[dict], str | None]:
        """Jobs, newest first, and the cursor of the next page, if there is one."""
        order = sorted(self._jobs.values(), key=lambda j: (-j.started, j.job_id))
        at = next((i for i, j in enumerate(order) if j.job_id == cursor), len(order)) if cursor else 0
        page, more = order[at : at + count], order[at + count : at + count + 1]
        fields = [
            {"job_id": j.job_id, "name": j.spec.name, "active": j.status == ACTIVE, "start_ms": int(j.started * 1000), "updated_ms": int(j.updated * 1000), "shards": len(j.shards) or j.spec.shards, "active_shards": (j.spec.shards or 1) if j.status == ACTIVE else 0, "result_status": None if j.status == ACTIVE else j.status} for j in page
        ]
        return fields, more[0].job_id if more else None

    def detail(self, job_id: str) -> dict:
        if job_id not in self._jobs:
            return {"error": f"no such job: {job_id}"}
        j = self._jobs[job_id]
        return {"job_id": job_id, "name": j.spec.name, "active": j.status == ACTIVE, "result_status": None if j.status == ACTIVE else j.status, "spec": asdict(j.spec), "counters": dict(j.counters), "shards": j.shards, "error": j.error}
