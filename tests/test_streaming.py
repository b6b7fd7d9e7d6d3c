from pyspark.sql import functions as F

from reposieve.plans.scan import scan
from reposieve.streaming import incremental

LOG = "owner string, name string, path string, scanner string, rule_id string, severity string, reason string, evidence string"


def test_stream_equals_batch_and_goes_on(spark, make_files, tmp_path):
    src, log, ck = (str(tmp_path / x) for x in ("src", "log", "ck"))
    first = make_files(("a.py", "def f(p): open(p)"), ("b.py", "x = 1"))
    second = make_files(("c.py", "def f(p): eval(p)"), ("d.js", "eval(1)"), name="late")
    for part in (first, second):
        part.write.mode("append").parquet(src)
        incremental.scan_stream(incremental.stream_files(spark, src), log, ck).awaitTermination()
    got = sorted(map(str, spark.read.schema(LOG).json(log).collect()))
    want = sorted(map(str, scan(first.union(second)).select(*(c.split()[0] for c in LOG.split(", "))).collect()))
    assert got == want and len(got) == 4


def test_seen_repositories_are_skipped(spark, make_files, tmp_path):
    src, log, ck = (str(tmp_path / x) for x in ("src", "log", "ck"))
    make_files(("a.py", "eval(1)")).union(make_files(("a.py", "eval(1)"), name="new")).write.parquet(src)
    seen = spark.createDataFrame([("o", "r")], "owner string, name string")
    files = incremental.unseen(incremental.stream_files(spark, src), seen)
    incremental.scan_stream(files, log, ck).awaitTermination()
    assert {r["name"] for r in spark.read.schema(LOG).json(log).collect()} == {"new"}


def test_rollup_keeps_growing(spark, make_files, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    want = {}
    for i in range(7):
        name = f"r{i % 3}"
        make_files((f"{i}.py", "eval(1)"), name=name).write.mode("append").parquet(src)
        want[name] = want.get(name, 0) + 1
        hits = scan(incremental.stream_files(spark, src))
        incremental.rollup_stream(hits, out, ck, keep=3).awaitTermination()
        each = {r["name"]: (r["findings"], r["severe"]) for r in incremental.read_rollup(spark, out).collect()}
        assert each == {n: (2 * k, k) for n, k in want.items()}
        # A batch writes what it changed; folded versions go.
        folders = [f for f in (tmp_path / "out").glob("*/version=*")]
        assert len(folders) <= 4
        assert spark.read.parquet(str(max((tmp_path / "out" / "changes").iterdir()))).count() == 1


def test_replayed_and_unfinished_batches(spark, tmp_path):
    out, write = str(tmp_path / "out"), incremental.rollup_writer(str(tmp_path / "out"), keep=3)
    schema = "owner string, name string, findings long, severe long"
    batches = [spark.createDataFrame([("o", f"r{k % 4}", k + 1, k), ("o", "all", 10 * k, 0)], schema) for k in range(8)]
    newest = lambda: {r["name"]: r["findings"] for r in incremental.read_rollup(spark, out).collect()}
    for k, batch in enumerate(batches):
        for _ in range(2):  # every batch is replayed, those that were folded in, too
            write(batch, k)
            want = {f"r{j % 4}": j + 1 for j in range(k + 1)} | {"all": 10 * k}
            assert newest() == want
        assert len(list((tmp_path / "out").glob("*/version=*"))) <= 5
    late = tmp_path / "out" / "changes" / "version=0000000009"
    spark.createDataFrame([("o", "r0", 99, 99)], schema).write.parquet(str(late))
    (late / "_SUCCESS").unlink()
    assert newest() == want
