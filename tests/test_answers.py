from pyspark.sql import functions as F

from meritlake.functions import answers as N
from meritlake.functions import companies as C
from meritlake.functions import rules as R


def parsed(spark, answers):
    frame = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    return N.parse_answers(frame, "answer").orderBy("i").collect()


def test_parse_paths(spark):
    rows = parsed(spark, [
        '```json\n{"employee_name": "A B", "n": 1}\n```', "{'employee_name': 'A B'}", '{employee_name: "A B",}',
        '{"employee_name": "A B", "employer": "C', '{"employee_name": "A B", "x": {"y": 1} "z"}', "nothing", None,
        '{"a": 1}}', '{"a": 1}, {"b": 2}'])
    assert [r.parse_path for r in rows] == [
        "direct", "repaired", "repaired", "fallback", "fallback", "fallback", "fallback", "fallback", "fallback"]
    assert [r.fields["employee_name"] for r in rows[:7]] == ["A B"] * 3 + ["Unknown", "A B", "Unknown", "Unknown"]
    assert rows[6].fields["confidence_level"] == "low"


def test_extraction_defaults(spark):
    frame = spark.createDataFrame([(
        '{"employee_name": null, "positions": [{"title": null, "employer": "E"}, 3, null, {"start_date": "x"}]}',)],
        "answer string")
    x = N.parse_answers(frame, "answer").select(N.clean_extraction(F.col("fields")).alias("x")).first().x
    assert x.employee_name == "Unknown Employee"
    assert [(p.title, p.employer) for p in x.positions] == [
        ("Unknown Position", "E"), ("Unknown Position", "Unknown Employer")]
    assert x.document_language is None


def evaluation(spark, *answers):
    frame = spark.createDataFrame(list(enumerate(answers)), "i int, answer string")
    return N.clean_evaluation(N.parse_answers(frame, "answer")).orderBy("i").collect()


def test_evaluation_rules(spark):
    rows = evaluation(
        spark,
        '{"Degree Relevance": "not directly related", "Recommendation": "general training", "requested_training_type": "professional"}',
        '{"degree_relevance": "High relevance text"}',
        '{"decision": null, "Decision": "ACCEPTED"}',
        '{"recommendation": "deny", "justification": {"justification": "why", "n": 1}}',
        '{"Recommendation": "x", "justification": null}',
        '{"Evidence Analysis": {"for_professional_training": "f"}, "supporting_evidence": "s", "challenging_evidence": "c"}')
    assert (rows[0].degree_relevance, rows[0].decision) == ("low", "REJECTED")
    assert rows[0].relevance_explanation == "not directly related"
    assert rows[1].degree_relevance == "High relevance text"
    assert rows[1].relevance_explanation == "High relevance text"
    assert rows[2].decision == "REJECTED"  # an explicit null keeps the other spelling out
    assert (rows[3].decision, rows[3].justification) == ("REJECTED", "why")
    assert (rows[4].decision, rows[4].justification) == ("ACCEPTED", "x")
    assert (rows[5].supporting_evidence, rows[5].challenging_evidence) == ("f", "c")
    assert rows[5].total_working_hours == "0"


def test_company_answers(spark):
    frame = spark.createDataFrame(list(enumerate([
        "The latest news on the company website", "Real company, address verified in the registry",
        '{"status": "UNVERIFIED"}', 'Well: {"status": "LEGITIMATE"}.', '{"status": broken} invalid', '{"status": broken} fake',
        '["LEGITIMATE"]', "5 years in business", "", None])), "i int, answer string")
    rows = C.parse_company_answers(frame, "answer").orderBy("i").collect()
    assert [(r.answer_path, r.company.status, r.counts_as_bad) for r in rows] == [
        ("paragraph", "NOT_LEGITIMATE", True),  # 'test' inside 'latest'
        ("paragraph", "LEGITIMATE", False), ("json", "UNVERIFIED", True), ("sliced", "LEGITIMATE", False),
        ("last_resort", "LEGITIMATE", False),  # 'valid' inside 'invalid' wins
        ("last_resort", "NOT_LEGITIMATE", True), ("none", "UNVERIFIED", False), ("paragraph", "LEGITIMATE", False),
        ("none", "UNVERIFIED", False), ("none", "UNVERIFIED", False)]
    assert rows[1].company.supporting_evidence == ["Address Verification: Address verified online"]
    assert len(rows[7].company.supporting_evidence) == 4


def test_extraction_types(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([
        '{"positions": [{"title": "x"}], "document_language": "en"}', '{"employee_name": 5}',
        '{"document_language": null}', '{"positions": null}', '{"positions": [1]}', '{"positions": [{"title": 3}]}', "{}"])],
        "i int, j string")
    got = [r.p for r in frame.select("i", R.extraction_problems(F.try_parse_json("j")).alias("p")).orderBy("i").collect()]
    assert got == [[], ["employee_name: not a text"], ["document_language: not a text"], ["positions: not a list"],
                   ["positions: item of wrong type"], ["positions: item of wrong type"], []]


def test_evaluation_checks(spark):
    base = dict(total_working_hours=100, requested_training_type="general", credits_qualified=3.0, degree_relevance="low",
                decision="ACCEPTED", relevance_explanation="a", calculation_breakdown="b", summary_justification="c",
                justification="d")
    cases = [({}, 0), ({"degree_relevance": "none"}, 1), ({"credits_qualified": -1.0}, 1), ({"credits_qualified": 31.0}, 1),
             ({"credits_qualified": 11.0}, 1), ({"total_working_hours": -1}, 1), ({"total_working_hours": 100001}, 1),
             ({"decision": "MAYBE"}, 1), ({"justification": None}, 1), ({"total_working_hours": None}, 0)]
    rows = [(i, *{**base, **change}.values()) for i, (change, _) in enumerate(cases)]
    frame = spark.createDataFrame(rows, "i int, total_working_hours int, requested_training_type string, "
                                  "credits_qualified double, degree_relevance string, decision string, relevance_explanation string, "
                                  "calculation_breakdown string, summary_justification string, justification string")
    got = [r.n for r in frame.select("i", F.size(R.evaluation_problems(
        {c: F.col(c) for c in base})).alias("n")).orderBy("i").collect()]
    assert got == [n for _, n in cases]


def test_correction_gate(spark):
    rows = [(True, 5.0, "ACCEPTED", False), (True, 31.0, "ACCEPTED", True), (True, 5.0, "PENDING", True),
            (False, 31.0, "PENDING", False), (None, 31.0, None, False), (True, None, None, True)]
    frame = spark.createDataFrame(rows, "r boolean, c double, d string, want boolean")
    got = frame.select("want", R.needs_correction(F.col("r"), F.col("c"), F.col("d")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
