import json
import time

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from meritlake.plans.catalog_rules import _evaluator
from meritlake.plans.driver_views import Tables
from meritlake.session import work_folder
from meritlake.sources.calls import ANSWERS, map_with_answers, map_with_caller
from meritlake.sources.documents import (
    process_documents, read_documents, read_text_documents, scan_document_inventory)
from meritlake.sources.keyed_store import KeyedStore
from meritlake.sources.tables import read_entity, read_workflow_files
from meritlake.streaming.certificates import last_status, read_arrivals, stream_evaluate, stream_status

FOLDER = "/root/testdata/sf0.001"


def _quota_after_two():
    seen = []

    def call(value):
        seen.append(value)
        if len(seen) > 2:
            raise RuntimeError("429 Quota exceeded for model")
        return f"one:{value}"

    return call


def _second():
    def call(value):
        if value == "bad":
            raise ValueError("broken input")
        return f"two:{value}"

    return call


def test_caller_moves_on_after_quota(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "b", "c", "bad", "d"])], "i int, v string").coalesce(1)
    rows = map_with_caller(frame, "v", ["i"], [("first", _quota_after_two), ("second", _second)]).orderBy("i").collect()
    assert [r.answer for r in rows] == ["one:a", "one:b", "two:c", None, "two:d"]
    assert [r.success for r in rows] == [True, True, True, False, True]
    assert [r.caller for r in rows] == ["first", "first", "second", "second", "second"]
    assert rows[3].error == "broken input"


def test_quota_of_the_last_caller_stays_with_the_row(spark):
    frame = spark.createDataFrame([(i, "x") for i in range(4)], "i int, v string").coalesce(1)
    rows = map_with_caller(frame, "v", ["i"], [("only", _quota_after_two)]).orderBy("i").collect()
    assert [r.success for r in rows] == [True, True, False, False]


def _slow():
    import time

    def call(value):
        time.sleep(0.2 if value.endswith("0") else 0.02)
        return f"said {value}"

    return call


def test_calls_under_way_together_keep_their_order(spark):
    frame = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "i int, v string").coalesce(1)
    started = time.perf_counter()
    rows = map_with_caller(frame, "v", ["i"], [("slow", _slow)], in_flight=8).collect()
    assert [(r.i, r.answer) for r in rows] == [(i, f"said v{i}") for i in range(40)]
    assert sum(r.elapsed for r in rows) > 1.4
    quota = map_with_caller(frame, "v", ["i"], [("first", _quota_after_two), ("second", _second)], in_flight=4).collect()
    assert all(r.success for r in quota) and [r.i for r in quota] == list(range(40))
    assert sum(r.caller == "first" for r in quota) == 2
    assert time.perf_counter() - started < 60


def test_calls_keep_a_rate_and_try_again(spark):
    frame = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "i int, v string").coalesce(1)

    def shaky():
        seen = {}

        def call(value):
            seen[value] = seen.get(value, 0) + 1
            if seen[value] <= int(value[1:]) % 3:
                raise RuntimeError("429 rate limit")
            return f"{value} after {seen[value]}"

        return call

    rows = map_with_caller(frame, "v", ["i"], [("shaky", shaky)], retries=2, first_wait=0.01).collect()
    assert [r.answer for r in rows] == [f"v{i} after {i % 3 + 1}" for i in range(6)]
    rows = map_with_caller(frame, "v", ["i"], [("shaky", shaky)], retries=1, first_wait=0.01).collect()
    assert [r.success for r in rows] == [i % 3 < 2 for i in range(6)]

    def timed():
        import time

        return lambda value: str(time.monotonic())

    rows = map_with_caller(frame, "v", ["i"], [("timed", timed)], in_flight=6, per_second=20).collect()
    times = sorted(float(r.answer) for r in rows)
    assert times[-1] - times[0] >= 0.2


def test_answers_are_asked_for_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def counted():
        def call(value):
            with open(log, "a") as file:
                file.write(f"{value}\n")
            if value == "bad":
                raise ValueError("broken")
            return f"said {value}"

        return call

    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None)], "i int, v string")
    store = KeyedStore(spark, str(tmp_path / "answers"), "prompt_hash", ANSWERS, buckets=4)
    want = [(1, "said a", True, None), (2, "said b", True, None), (3, "said a", True, None), (4, None, False, "broken"), (5, "said None", True, None)]
    for run, calls in enumerate((["None", "a", "b", "bad"], ["bad"])):
        open(log, "w").close()
        rows = map_with_answers(frame, "v", ["i"], [("counted", counted)], store, in_flight=2).collect()
        assert sorted((r.i, r.answer, r.success, r.error) for r in rows) == want
        assert sorted(open(log).read().split()) == calls, run
    assert store.read().count() == 3


def _decode():
    return lambda content: content.decode("utf-8")


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.PDF").write_bytes("Työtodistus\r\n\r\n hyvä ".encode())
    (tmp_path / "in" / "deep" / "b.docx").write_bytes(b"plain words")
    (tmp_path / "in" / "c.png").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "d.txt").write_bytes(b"not listed")
    (tmp_path / "in" / "e.jpg").write_bytes(b" \n ")
    (tmp_path / "in" / "f.jpg").write_bytes(b"")  # the file source leaves out files of zero bytes
    folder = str(tmp_path / "in")
    listing = scan_document_inventory(spark, folder).collect()
    assert [r.file_name for r in listing] == ["a.PDF", "c.png", "b.docx", "e.jpg"]
    rows = {r.file_name: r for r in process_documents(read_documents(spark, folder), "content", [("utf8", _decode)]).collect()}
    assert (rows["a.PDF"].extracted_text, rows["a.PDF"].detected_language) == ("Työtodistus\nhyvä", "fin")
    assert round(rows["b.docx"].confidence, 4) == 0.9
    assert not rows["c.png"].success and "decode" in rows["c.png"].error
    assert rows["e.jpg"].error == "No text extracted from document"
    texts = read_text_documents(spark, f"{folder}/d.txt").collect()
    assert [r.text for r in texts] == ["not listed"]


def test_stored_workflow_files(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({
        "success": True, "extra": 1, "evaluation_results": {"success": True, "results": {"decision": "ACCEPTED"}}}, indent=2))
    row = read_workflow_files(spark, str(tmp_path)).first()
    assert row.workflow.evaluation_results.results.decision == "ACCEPTED"


def test_entity_scan_prunes(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.createDataFrame([("1", "s", b"xx")], "certificate_id string, student_id string, file_content binary").write.parquet(path)
    plan = read_entity(spark, "certificates", path).select("certificate_id")._jdf.queryExecution().executedPlan().toString()
    assert "file_content" not in plan


def decision_store(spark, evaluate, certificates, buckets=8):
    return KeyedStore(spark, work_folder(spark, "out"), "certificate_id", evaluate(certificates.limit(0)).schema, buckets)


def test_stream_equals_batch_with_repeats_and_restart(spark):
    tables = Tables(spark, FOLDER)
    drops = work_folder(spark, "drops")
    certificates = tables.certificates
    certificates.where("certificate_id < 900").coalesce(1).write.parquet(f"{drops}/one")
    output, state = decision_store(spark, _evaluator(tables), certificates), work_folder(spark, "state")

    def run():
        arrivals = read_arrivals(spark, certificates.schema, f"{drops}/*", files_per_batch=1)
        stream_evaluate(arrivals, _evaluator(tables), output, state).awaitTermination()

    run()
    certificates.where("certificate_id >= 600").coalesce(1).write.parquet(f"{drops}/two")
    run()
    # a lost checkpoint replays everything; the stored decisions still keep repeats out
    before, state = output.snapshots(), work_folder(spark, "state")
    run()
    assert output.snapshots() == before
    streamed = output.read()
    batch = entry_points.queries()["evaluate_certificates"](spark, FOLDER)
    assert streamed.count() == batch.count() == streamed.select("certificate_id").distinct().count()
    assert streamed.exceptAll(batch.select(*streamed.columns)).count() == 0


def test_late_certificates_are_kept(spark):
    """Four batches, the oldest dates last, repeats among them, decisions in between: the same rows as one batch."""
    tables = Tables(spark, FOLDER)
    certificates, drops, decided = tables.certificates, work_folder(spark, "drops"), work_folder(spark, "decided")
    days = [str(r.day) for r in certificates.selectExpr(
        "explode(percentile(unix_micros(uploaded_at), array(0.25, 0.5, 0.75))) AS day").collect()]
    at = F.expr("unix_micros(uploaded_at)")
    parts = [at >= float(days[2]), (at >= float(days[1])) & (at < float(days[2])),
             (at >= float(days[0])) & (at < float(days[1])), at < float(days[0])]
    output, states = decision_store(spark, _evaluator(tables), certificates), [work_folder(spark, n) for n in ("s1", "s2")]
    statuses = work_folder(spark, "status")
    for number, part in enumerate(parts):
        # each drop repeats some rows of the first one
        certificates.where(part | (parts[0] & F.expr("certificate_id % 7 = 0"))).coalesce(1).write.parquet(f"{drops}/{number}")
        tables.decisions.where(f"certificate_id % 4 = {number} OR certificate_id % 12 = 0").coalesce(1).write.parquet(f"{decided}/{number}")
        arrivals = read_arrivals(spark, certificates.schema, f"{drops}/*", files_per_batch=1)
        stream_evaluate(arrivals, _evaluator(tables), output, states[0]).awaitTermination()
        decisions = read_arrivals(spark, tables.decisions.schema, f"{decided}/*", files_per_batch=1)
        stream_status(arrivals, decisions, statuses, states[1]).awaitTermination()
    changes = spark.read.parquet(statuses)
    # each change once: processing and completed at most once each, in this order
    assert changes.groupBy("certificate_id", "status").count().where("count > 1").count() == 0
    assert changes.where("status = 'processing'").count() > 100
    turned = changes.groupBy("certificate_id").agg(F.max_by("status", "batch").alias("last"), F.collect_set("status").alias("all"))
    assert turned.where("last = 'processing' AND array_contains(all, 'completed')").count() == 0
    for name, streamed in (("evaluate_certificates", output.read()), ("stream_status", last_status(changes))):
        batch = entry_points.queries()[name](spark, FOLDER)
        streamed = streamed.select(*batch.columns)
        assert streamed.count() == batch.count() == certificates.count()
        assert streamed.exceptAll(batch).count() == 0


def test_status_goes_from_processing_to_completed(spark):
    tables = Tables(spark, FOLDER)
    drops, decided, output, state = (work_folder(spark, n) for n in ("drops", "decided", "status", "state"))
    certificates = spark.createDataFrame([(1,), (2,), (3,)], "certificate_id bigint")
    empty = tables.decisions.limit(0)
    one = tables.decisions.limit(1).drop("certificate_id", "decision_id", "ai_decision", "created_at")

    def decision(certificate, name, verdict, when):
        return one.selectExpr(f"{certificate}L AS certificate_id", f"'{name}' AS decision_id", f"'{verdict}' AS ai_decision",
                              f"TIMESTAMP '{when}' AS created_at", "*").select(*empty.columns)

    def run(batch, new_certificates, new_decisions):
        if new_certificates is not None:
            new_certificates.coalesce(1).write.parquet(f"{drops}/{batch}")
        (new_decisions if new_decisions is not None else empty).coalesce(1).write.parquet(f"{decided}/{batch}")
        stream_status(read_arrivals(spark, certificates.schema, f"{drops}/*"), read_arrivals(spark, empty.schema, f"{decided}/*"),
                      output, state).awaitTermination()
        return {(r.certificate_id, r.status, r.ai_decision) for r in last_status(spark.read.parquet(output)).collect()}

    first = run(0, certificates.where("certificate_id < 3"), decision(9, "early", "ACCEPTED", "2024-01-01"))
    assert first == {(1, "processing", None), (2, "processing", None)}
    done = run(1, None, decision(1, "d1", "ACCEPTED", "2024-01-02"))
    assert done == {(1, "completed", "ACCEPTED"), (2, "processing", None)}
    # the same events again tell nothing new
    rows = spark.read.parquet(output).count()
    run(2, certificates.where("certificate_id < 3"), decision(1, "d1", "ACCEPTED", "2024-01-02"))
    assert spark.read.parquet(output).count() == rows
    # a later decision replaces the first one; a decision that came before its certificate counts
    nine = spark.createDataFrame([(9,)], "certificate_id bigint")
    last = run(3, nine, decision(1, "d2", "REJECTED", "2024-02-01"))
    assert last == {(1, "completed", "REJECTED"), (2, "processing", None), (9, "completed", "ACCEPTED")}


def test_a_batch_reads_its_buckets_only(spark):
    """The files of a batch do not grow with what was stored before."""
    path, opened = work_folder(spark, "store"), []
    store = KeyedStore(spark, path, "k", "k long, v string", buckets=16)
    for batch in range(12):
        store.insert_new(spark.range(batch * 500, batch * 500 + 500).selectExpr("id AS k", "'x' AS v"))
        few = spark.createDataFrame([(7,)], "k long")
        opened.append(len(store.matching(few).inputFiles()) if batch else 0)
        assert [tuple(r) for r in store.matching(few).collect()] == [(7, "x")]
    assert max(opened) <= 4 + 2 and store.read().count() == 6000
    assert max(sum(p.bucket == b for p in store.parts()) for b in range(16)) <= 4


def test_invariants(spark):
    rows = entry_points.queries()["evaluate_certificates"](spark, FOLDER)
    caps = F.when(F.col("requested_type") == "professional", 30.0).otherwise(10.0)
    assert rows.where(F.col("credits_qualified") > caps).count() == 0
    assert rows.groupBy("certificate_id").count().where("count > 1").count() == 0
    assert rows.where(~F.col("ai_decision").isin("ACCEPTED", "REJECTED")).count() == 0


def test_stream_reads_the_large_tables_once(spark, monkeypatch):
    """No batch plans a scan of line items or orders: what they tell of certificates was totalled before."""
    from meritlake.plans import catalog_rules

    plans, plain = [], catalog_rules._evaluator

    def spied(t, *rest):
        evaluate = plain(t, *rest)

        def run(certificates):
            result = evaluate(certificates)
            plans.append((certificates.limit(1).count(), result._jdf.queryExecution().optimizedPlan().toString()))
            return result

        return run

    monkeypatch.setattr(catalog_rules, "_evaluator", spied)
    streamed = entry_points.queries()["stream_evaluate"](spark, FOLDER)
    batches = [plan for rows, plan in plans if rows]
    assert len(batches) >= 2 and not any("l_orderkey" in plan or "o_orderkey" in plan for plan in batches)
    batch = entry_points.queries()["evaluate_certificates"](spark, FOLDER).select(*streamed.columns)
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0
