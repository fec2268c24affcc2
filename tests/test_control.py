"""Jobs, handlers, configurations, quotas and pools."""

import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import config, context, mutations, operations, status
from millrace.operators.jobs import Hooks, Jobs, JobSpec
from millrace.operators.mapper import resolve, yields
from millrace.operators.operations import Delete, Increment, Put
from millrace.operators.quota import Buckets, Consumer

SEEN = []


def even_or_odd(row):
    if row["id"] % 2 == 0:
        yield Put(row["id"], {"id": row["id"], "name": f"n{row['id']}"})
    else:
        yield Delete(row["id"])
    yield Increment("even" if row["id"] % 2 == 0 else "odd")
    yield "junk"


def fails(row):
    raise ValueError("no")


def slow(row):
    time.sleep(0.5)


def done(job_id):
    SEEN.append(job_id)


def check_params(params):
    if params.get("name") == "bad":
        raise ValueError("bad name")
    params["checked"] = "yes"


class Called:
    def __call__(self, row):
        return Increment("called", 2)

    def method(self, row):
        return Increment("method")


def jobs(spark, **more):
    return Jobs(spark, {"numbers": lambda s, p: s.range(int(p.get("n", 20)))}, **more)


def test_handlers_yield_operations(spark):
    ops = operations.run_handler(spark.range(0, 10, 1, 3), even_or_odd)
    assert {r["name"]: r["value"] for r in operations.counters(ops).collect()} == {"even": 5, "odd": 5, "mapper_calls": 10}
    rows = operations.mutations(ops, "id long, name string", "id")
    base = spark.createDataFrame([(1, "x"), (2, "x"), (50, "x")], "id long, name string")
    after = mutations.apply_pool(base, rows, ["id"])
    assert sorted(map(tuple, after.collect())) == [(0, "n0"), (2, "n2"), (4, "n4"), (6, "n6"), (8, "n8"), (50, "x")]


def test_handler_names():
    assert resolve("tests.test_control.done") is done
    assert resolve("tests.test_control.Called")({}) == Increment("called", 2)
    assert resolve("tests.test_control.Called.method")({}) == Increment("method")
    assert yields(even_or_odd) and not yields(done)
    with pytest.raises((ImportError, AttributeError)):
        resolve("tests.test_control.nothing")
    with pytest.raises(ImportError):
        resolve("no_such_module.f")


def test_job_runs_to_success(spark):
    written, hooked = [], []

    class Watch(Hooks):
        def on_start(self, job_id, spec):
            hooked.append("start")

        def on_done(self, job_id, status):
            hooked.append(status)

    all_jobs = jobs(spark, sink=lambda ops, spec: written.append(ops.where("op = 'put'").count()), hooks=Watch())
    job_id = all_jobs.start(JobSpec("j", "tests.test_control.even_or_odd", "numbers", {"n": 20}, {"done_callback": "tests.test_control.done"}, shards=3))
    assert all_jobs.wait(job_id, 120) == "success"
    detail = all_jobs.detail(job_id)
    assert detail["counters"] == {"mapper_calls": 20, "even": 10, "odd": 10}
    assert sum(s["processed"] for s in detail["shards"]) == 20 and len(detail["shards"]) == 3
    assert written == [10] and hooked == ["start", "success"] and job_id in SEEN
    assert all_jobs.cleanup(job_id) and "error" in all_jobs.detail(job_id) and not all_jobs.cleanup(job_id)


def test_job_fails_and_aborts(spark):
    all_jobs = jobs(spark)
    bad = all_jobs.start(JobSpec("bad", "tests.test_control.fails", "numbers"))
    assert all_jobs.wait(bad, 120) == "failed" and "no" in all_jobs.detail(bad)["error"]
    stopped = all_jobs.start(JobSpec("slow", "tests.test_control.slow", "numbers", {"n": 4000}))
    time.sleep(3)
    all_jobs.abort(stopped)
    assert all_jobs.wait(stopped, 120) == "aborted"
    all_jobs.abort(bad)
    assert all_jobs.detail(bad)["result_status"] == "failed"
    page, cursor = all_jobs.list(1)
    assert [j["job_id"] for j in page] == [stopped] and cursor == bad
    page, cursor = all_jobs.list(1, cursor)
    assert [j["job_id"] for j in page] == [bad] and cursor is None


def test_job_is_validated(spark):
    all_jobs = jobs(spark)
    for spec in (JobSpec("j", "tests.test_control.slow", "nowhere"), JobSpec("j", "tests.test_control.nothing", "numbers"), JobSpec("j", "tests.test_control.slow", "numbers", shards=0)):
        with pytest.raises((ValueError, AttributeError, ImportError)):
            all_jobs.start(spec)


def test_spec_from_form():
    form = {"name": "n", "mapper_input_reader": "numbers", "mapper_handler": "h.f", "mapper_params.a": ["1", "2"], "mapper_params.shard_count": "5", "params.b": ["x"], "mapper_params_validator": "tests.test_control.check_params"}
    spec = JobSpec.from_form(form)
    assert spec.params == {"a": ["1", "2"], "shard_count": "5", "checked": "yes"} and spec.job_params == {"b": "x"}
    assert spec.shards == 5 and spec.rate == 100 and JobSpec.from_json(spec.to_json()) == spec
    with pytest.raises(ValueError, match="mapper_handler"):
        JobSpec.from_form({"name": "n", "mapper_input_reader": "r"})
    with pytest.raises(ValueError, match="bad name"):
        JobSpec.from_form(form | {"mapper_params.name": "bad"})


YAML = """
mapreduce:
- name: Mapreduce1
  mapper:
    handler: Handler1
    input_reader: Reader1
    params_validator: tests.test_control.check_params
    params:
    - name: entity_kind
      default: Kind1
    - name: human_supplied1
    - name: human_supplied2
- name: Mapreduce2  # a comment
  mapper:
    handler: "Handler2"
    input_reader: Reader2
  params:
  - name: after
    value: done
"""


def test_yaml():
    first, second = config.load_jobs(YAML)
    assert first == {"name": "Mapreduce1", "mapper_handler": "Handler1", "mapper_input_reader": "Reader1", "mapper_params_validator": "tests.test_control.check_params", "mapper_params": {"entity_kind": "Kind1", "human_supplied1": None, "human_supplied2": None}}
    assert second == {"name": "Mapreduce2", "mapper_handler": "Handler2", "mapper_input_reader": "Reader2", "params": {"after": "done"}}
    spec = config.spec_of(first, {"mapper_params.human_supplied1": "me"})
    assert spec.params["human_supplied1"] == "me" and spec.params["checked"] == "yes"
    assert config.load_jobs("") == []
    for bad in (YAML.replace("    handler: Handler1\n", ""), YAML.replace("    input_reader: Reader2\n", ""), YAML.replace("Mapreduce2", "Mapreduce1"), YAML.replace("human_supplied1", "$$Invalid$$"), YAML + "---" + YAML):
        with pytest.raises(config.ConfigError):
            config.load_jobs(bad)


def template(*properties):
    return config.Template("<configuration>" + "".join(properties) + "</configuration>")


def test_xml_templates():
    fixed = "<property><name>binky</name><value>winky</value></property>"
    needed = '<property><name human="Foo\'bar">foo</name><value template="required" /></property>'
    free = '<property><name>baz</name><value template="optional">Whee</value></property>'
    assert template(fixed).fill({}) == {"binky": "winky"}
    assert template(needed).fill({"foo": "zzz"}) == {"foo": "zzz"}
    assert template(needed).parameters() == {"foo": {"name": "foo", "human_name": "Foo'bar"}}
    assert template(free).fill({}) == {"baz": "Whee"}
    assert template(free.replace("Whee", "")).fill({}) == {"baz": ""}
    with pytest.raises(config.MissingParameter):
        template(needed).fill({})
    with pytest.raises(config.UnexpectedParameter):
        template(fixed).fill({"foo": "bar"})
    twice = template(free)
    twice.fill({})
    with pytest.raises(RuntimeError):
        twice.fill({})
    found = config.load_templates('<configurations><configuration name="Foo"/><configuration name="Bar"><property><name>Baz</name><value template="optional">2</value></property></configuration></configurations>')
    assert found.keys() == {"Foo", "Bar"} and found["Bar"].fill({}) == {"Baz": "2"}


def test_buckets():
    b = Buckets()
    assert b.get("a") == 0 and b.consume("a", 5) == 0
    b.set("a", 7)
    assert b.consume("a", 20) == 0 and b.get("a") == 7
    assert b.consume("a", 20, some=True) == 7 and b.get("a") == 0
    assert b.consume("a", 20, some=True) == 0
    b.put("a", 300)
    consumer = Consumer(b, "a", 50)
    assert consumer.consume(1) and b.get("a") == 250
    consumer.dispose()
    assert b.get("a") == 299
    b.set("a", 321)
    greedy = Consumer(b, "a", 50)
    assert not greedy.consume(500)
    assert greedy.check(321) and not greedy.check(322)
    greedy.dispose()
    assert b.get("a") == 321


def test_pools():
    written = []
    pool = mutations.MutationPool(lambda p, d: written.append((len(p), len(d))), count=100)
    for i in range(150):
        pool.put(i)
    assert written == [(100, 0)] and len(pool.puts) == 50
    pool.delete(1)
    pool.flush()
    pool.flush()
    assert written == [(100, 0), (50, 1)]
    written.clear()
    pool = mutations.MutationPool(lambda p, d: written.append(len(p)), size=1000)
    pool.put("small", 10)
    pool.put("large", 1000)
    assert written == [1] and pool.puts == ["large"]
    for limit, flushed in ((2, [2]), (3, [3])):
        written.clear()
        pool = mutations.MutationPool(lambda p, d: written.append(len(p)), count=limit, before=False)
        for i in range(3):
            pool.put(i)
        assert written == flushed
    assert mutations.MutationPool(print, retries=2).count == 125


def test_status_of_ordered_and_repeated_mutations(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    ops = spark.createDataFrame([("delete", 0, 1, None), ("put", 1, 1, "x"), ("put", 2, 3, "y"), ("put", 3, 3, "z")], "op string, seq long, k long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(mutations.apply_pool(base, ops, ["k"])) == [(2, "b"), (3, "z")]
    assert rows(mutations.apply_pool(base, ops, ["k"], ordered=True)) == [(1, "x"), (2, "b"), (3, "z")]
    once = mutations.apply_pool(base, ops, ["k"])
    assert rows(mutations.apply_pool(once, ops, ["k"])) == rows(once)
    assert rows(mutations.put(base, ops.where(F.lit(False)).select("k", "v"), ["k"])) == [(1, "a"), (2, "b")]


def test_pace():
    now = [0.0]
    pace = operations.Pace(10, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    at = []
    for _ in range(35):
        pace.take()
        at.append(now[0])
    assert all(n <= 10 * t + 1.001 for n, t in enumerate(at, 1)) and 3.3 <= at[-1] <= 3.6
    with pytest.raises(ValueError):
        operations.Pace(0)


def test_paced_job(spark):
    rows = {"numbers": lambda s, p: s.range(0, 60, 1, 2)}
    jobs = Jobs(spark, rows)
    form = {"name": "n", "mapper_input_reader": "numbers", "mapper_handler": "tests.test_control.slow_count", "mapper_params.shard_count": "2"}
    for more, least, most in (({"mapper_params.processing_rate": "30"}, 1.8, 30), ({"mapper_params.processing_rate": "1", "mapper_params.enable_quota": "false"}, 0, 30)):
        spec = JobSpec.from_form(form | more)
        began = time.time()
        job = jobs.start(spec)
        assert jobs.wait(job, 60) == status.SUCCESS and jobs.detail(job)["counters"]["seen"] == 60
        assert least <= time.time() - began <= most
    with pytest.raises(ValueError):
        jobs.start(JobSpec("n", "tests.test_control.slow_count", "numbers", rate=0))


def slow_count(row):
    context.current().increment("seen")
    context.current().status = f"at {row['id']}"


def test_status_rules_agree(spark):
    cases = [(states, expected, abort) for states in (["success"], ["active", "failed"], ["success", "failed"], ["aborted", "success"]) for expected in (1, 2) for abort in (True, False)]
    rows = [(k, s, e, a) for k, (states, e, a) in enumerate(cases) for s in states]
    got = {r["job"]: r["status"] for r in status.roll_up(spark.createDataFrame(rows, "job int, state string, expected int, abort boolean"), "job", "state", "expected", "abort").collect()}
    assert got == {k: status.job_status(*case) for k, case in enumerate(cases)}


def test_context():
    class Kept:
        def __init__(self):
            self.held = []

        def flush(self):
            out, self.held = self.held, []
            return out

    assert context.current() is None
    with context.Context(3, attempt=2, params={"a": 1}) as task:
        assert context.current() is task and task.params == {"a": 1} and task.mutations.count == 125
        assert task.pool("mutations") is task.mutations and task.pool("other") is None
        kept = Kept()
        task.register("kept", kept)
        kept.held.append("x")
        task.mutations.put("p")
        task.mutations.delete("d")
        task.increment("n")
        task.increment("n", 4)
        assert task.flush() == ["p", "d", "x"] and task.flush() == [] and task.counters == {"n": 5}
    assert context.current() is None


def test_sink_of_mutations(spark, tmp_path):
    from millrace.sources import pools

    path = str(tmp_path / "m")
    ops = spark.range(0, 250, 1, 2).select(F.when(F.col("id") % 5 == 0, "delete").otherwise("put").alias("op"), F.col("id").alias("seq"), F.col("id").cast("string").alias("key"), F.lit("{}").alias("payload"))
    pools.write_mutations(ops, path, count=10)
    pools.write_mutations(ops.where("seq < 3"), path)
    bad = ops.withColumn("op", F.when(F.col("seq") == 200, "neither").otherwise(F.col("op")))
    with pytest.raises(Exception, match="neither"):
        pools.write_mutations(bad, path)
    got = pools.read_mutations(spark, path).collect()
    assert sorted(r["seq"] for r in got) == sorted([*range(250), 0, 1, 2])
    assert sorted((m["flushes"], m["rows"]) for m in pools.manifests(path)) in ([(1, 3), (26, 250)], [(2, 3), (26, 250)])
    for flush in range(12):
        for rows in [[r for r in got if r["flush"] == flush and (r["seq"] < 125) == low and r["seq"] > 2] for low in (True, False)]:
            assert len(rows) <= 10
    assert pools.read_mutations(spark, str(tmp_path / "none")).count() == 0
