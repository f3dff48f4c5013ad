"""Table functions, the data source, saved texts, balanced choices and outlines."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions.outline import outline
from lectern.operators import allocation, prompts, review, rules, sections, tables
from lectern.sources import benchmark, review_source

TEXTS = ["封面\n前言\n甲\n[1] 范围\n本文件\x85续\n [ 附录A ]（规范性）\n\n乙　\n参考文献\n[1] GB/T 1", None, "", "[5.1.1.1.1.1] 适用范围\r\n[3] x\r[3] 术语\n[2]y", "没有标题"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(TEXTS)], "doc_id string, source_text string")


def test_outline_is_the_parser(docs):
    want = sorted(map(str, ((f"{i:03d}", *x) for i, t in enumerate(TEXTS) for x in outline(t))))
    assert want == sorted(str((r["doc_id"], r["ord"], r["section_number"], r["title"], r["content"])) for r in sections.parse_sections(docs).collect())


def test_table_functions(spark, docs):
    tables.register_tables(spark)
    docs.createOrReplaceTempView("t_docs")
    s = sections.parse_sections(docs)
    s.createOrReplaceTempView("t_sections")
    assert spark.sql("SELECT d.doc_id, o.* FROM t_docs d, LATERAL parse_outline(d.source_text) o").exceptAll(s).count() == 0
    review = lambda most: spark.sql(f"SELECT * FROM review_structure(TABLE(t_sections), CAST({most} AS INT))")
    found = {(r["error_type"], r["reason"]) for r in review("NULL").collect()}
    issues = rules.order_issues(s).where("kind = 'sequence'").collect()
    assert found == {("E-S-02", f"{r['prev']} > {r['curr']}") for r in issues} | {("E-S-03", f"{r['title']} > {r['standard_title']}") for r in rules.name_issues(s).collect()} | {("E-S-06", str(r["depth"])) for r in rules.depth_issues(s).collect()} and issues
    assert review(1).groupBy("doc_id").count().agg(F.max("count")).first()[0] == 1
    with pytest.raises(Exception, match="lack the columns"):
        spark.sql("SELECT * FROM review_structure(TABLE(SELECT doc_id, ord FROM t_sections), 1)")


def test_saved_texts_keep_their_ids(spark, docs, tmp_path):
    rows = docs.union(spark.createDataFrame([("7", "a"), ("007", "b"), ("010", "c"), (None, "d")], docs.schema))
    benchmark.write_texts(rows, str(tmp_path / "t"))
    assert sorted(map(str, benchmark.read_texts(spark, str(tmp_path / "t")).collect())) == sorted(map(str, rows.collect()))


def test_source_reads_in_parts_and_takes_filters(spark, docs, tmp_path):
    review_source.register_sources(spark)
    path = str(tmp_path / "t")
    benchmark.write_texts(docs.repartition(4), path)
    read = spark.read.format("review_sections").option("bytes_per_task", 1).load(path)
    s = sections.parse_sections(docs)
    assert read.rdd.getNumPartitions() >= 3 and sorted(map(str, read.collect())) == sorted(map(str, s.select(read.columns).collect()))
    for condition in ("doc_id = '003'", "doc_id in ('000', '004')", "section_number like '5%'", "doc_id = '003' and section_number like '3%' and title <> 'x'", "section_number is null"):
        assert sorted(map(str, read.where(condition).collect())) == sorted(map(str, s.select(read.columns).where(condition).collect()))
    plan = read.where("doc_id = '003'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (doc_id" not in plan and "Filter (isnotnull" not in plan
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("review_sections").load().collect()
    os.makedirs(tmp_path / "none")
    assert spark.read.format("review_sections").load(str(tmp_path / "none")).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    review_source.register_sources(spark)
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(folder)

    def put(name, *ids):
        with open(f"{folder}/_{name}", "w") as f:
            f.writelines(json.dumps({"doc_id": i, "source_text": f"[1] {i}\nx"}) + "\n" for i in ids)
        os.rename(f"{folder}/_{name}", f"{folder}/{name}.json")
        time.sleep(0.02)

    def run():
        stream = spark.readStream.format("review_sections").load(folder).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        stream.awaitTermination(120)
        return sorted(r["doc_id"] for r in spark.read.parquet(out).collect())

    put("b", "1", "2")
    assert run() == ["1", "2"]
    put("a", "3")  # its name comes before, its time behind
    put("c", "4")
    assert run() == ["1", "2", "3", "4"] == run()


def sequential(fitting, used, seed):
    counts, chosen = dict(used), {}
    for key, doc in sorted((",".join(sorted(set(t))), d) for d, t in fitting if t):
        kind = min(allocation.tie_order(key.split(","), seed), key=lambda t: counts.get(t, 0))
        counts[kind] = counts.get(kind, 0) + 1
        chosen[doc] = kind
    return chosen, counts


@pytest.mark.parametrize("used", [{}, {"a": 40, "c": 3}, {"a": 1, "b": 1, "d": 500}])
def test_balanced_choices_are_a_counter_in_order(spark, used):
    rng = random.Random(len(used))
    fitting = [(i, rng.sample("abcde", rng.randint(0, 4))) for i in range(400)] + [(i, ["d"]) for i in range(400, 430)]
    got = {r["doc_id"]: r["error_type"] for r in allocation.balanced_choices(spark.createDataFrame(fitting, "doc_id int, types array<string>").repartition(5), used, 9).collect()}
    assert got == sequential(fitting, used, 9)[0]
    assert allocation.balanced_choices(spark.createDataFrame([], "doc_id int, types array<string>"), used).count() == 0


def test_turns_take_no_room():
    used = {"a": 5, "b": 0, "c": 10**12}
    assert len(allocation.least_used_turns(["a", "b", "c"], used, 10**12)) <= 3 and sum(used.values()) == 2 * 10**12 + 5 and abs(used["a"] - used["b"]) <= 1


def counting(folder, dies=False):
    """A client that leaves a file for each call; with dies, the process ends at the seventh prompt, once."""

    def client(prompt, system=None):
        open(f"{folder}/{prompt}-{time.time_ns()}", "w").close()
        if prompt == "p6" and dies and not os.path.exists(f"{folder}/died"):
            open(f"{folder}/died", "w").close()
            os._exit(1)
        if prompt == "bad":
            raise TimeoutError
        return f"{prompt}{system or ''}!"

    return client


def calls(folder):
    return sorted(x.rsplit("-", 1)[0] for x in os.listdir(folder) if x != "died")


def test_a_prompt_is_asked_once(spark, tmp_path):
    said, folder = str(tmp_path / "said"), str(tmp_path / "calls")
    os.makedirs(folder)
    rows = [(i, f"p{i % 20}") for i in range(60)]
    asks = spark.createDataFrame(rows, "doc_id int, prompt string").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017  the worker's end fails the job, as local mode does not repeat tasks
        review.asked_once(asks, counting(folder, True), said, calls=1, tries=1).collect()
    assert 1 <= len(calls(folder)) < 20
    for _ in range(2):
        got = review.asked_once(asks, counting(folder, True), said, calls=1, tries=1)
        assert sorted(map(tuple, got.collect())) == sorted((i, f"{p}!", False) for i, p in rows)
    asked = calls(folder)
    assert sorted(set(asked)) == sorted({p for _, p in rows}) and len(asked) == 21  # p6 was under way when its process ended


def test_failed_calls_are_tried_again(spark, tmp_path):
    said, folder = str(tmp_path / "said"), str(tmp_path / "calls")
    os.makedirs(folder)
    asks = spark.createDataFrame([(1, "bad", "s"), (2, "a", "s"), (3, "a", "t")], "doc_id int, prompt string, system string")
    ask = lambda: sorted(map(tuple, review.asked_once(asks, counting(folder), said, tries=3, pause=0.01).collect()))
    assert ask() == [(1, None, True), (2, "as!", False), (3, "at!", False)]
    assert calls(folder) == ["a", "a", "bad", "bad", "bad"]
    ask()
    assert calls(folder) == ["a", "a"] + ["bad"] * 6  # answers stay, a failure is asked anew
    assert review.asked_once(asks.where("false"), counting(folder), str(tmp_path / "none")).count() == 0


def test_calls_run_at_once(spark, tmp_path):
    def slow(prompt):
        time.sleep(0.3)
        return prompt

    asks = spark.createDataFrame([(i, f"q{i}") for i in range(32)], "doc_id int, prompt string").coalesce(1)
    began = time.time()
    assert review.asked_once(asks, slow, str(tmp_path / "said"), calls=16).count() == 32
    assert time.time() - began < 0.3 * 32


def test_a_review_again_asks_nothing(spark, tmp_path):
    folder, docs = str(tmp_path / "calls"), spark.createDataFrame([("d", "[5] 要求\n产品宜检查，应干燥")], "doc_id string, source_text string")
    os.makedirs(folder)

    def client(prompt, system):
        open(f"{folder}/{time.time_ns()}-{os.getpid()}", "w").close()
        return "[]"

    first = prompts.agentic_review(docs, client, replies=str(tmp_path / "said")).collect()
    n = len(os.listdir(folder))
    assert prompts.agentic_review(docs, client, replies=str(tmp_path / "said")).collect() == first and len(os.listdir(folder)) == n > 5
