import json

from meritlake.operators.degrees import degree_catalogue
from meritlake.plans.model_evaluation import evaluate_with_model


def scripted():
    def extraction():
        def call(prompt):
            name = "Jane Smith" if "Jane" in prompt else "John Doe"
            return json.dumps({"employee_name": name, "employer": "Works", "employer_address": "Street 1",
                               "positions": [{"title": "t", "employer": "Works"}, {"title": "u", "employer": ""}]})

        return call

    def evaluation():
        def call(prompt):
            if "Jane" in prompt:
                raise RuntimeError("a rejected certificate was evaluated")
            if "broken" in prompt:
                raise RuntimeError("no answer")
            decision = "MAYBE" if "undecided" in prompt else "ACCEPTED"
            return json.dumps({"total_working_hours": 837, "decision": decision, "justification": "because"})

        return call

    def company():
        def call(prompt):
            assert "Street 1" in prompt
            return '{"status": "NOT_LEGITIMATE"}'

        return call

    def validation():
        def call(prompt):
            assert "NOT_LEGITIMATE" in prompt
            return '{"requires_correction": true}'

        return call

    def correction():
        def call(prompt):
            if "undecided" not in prompt:
                raise RuntimeError("a settled certificate was corrected")
            return '{"evaluation_results": {"credits_qualified": 12, "decision": "ACCEPTED"}}'

        return call

    return {f.__name__: [("scripted", f)] for f in (extraction, evaluation, company, validation, correction)}


def test_stages(spark):
    certificates = spark.createDataFrame(
        [(1, 1, "GENERAL", "a plain certificate"), (2, 1, "GENERAL", "certificate of Jane"), (3, 1, "GENERAL", "short"),
         (4, 1, "PROFESSIONAL", "an undecided certificate"), (5, 1, "GENERAL", "a broken certificate"),
         (6, 99, "GENERAL", "nobody knows the owner")],
        "certificate_id int, student_id int, training_type string, text string")
    students = spark.createDataFrame([(1, "John", "Doe", "Business")], "student_id int, first_name string, last_name string, degree string")
    keywords = spark.createDataFrame([("general", "role", "clerk")], "programme_key string, kind string, keyword string")
    rows = {r.certificate_id: r for r in evaluate_with_model(
        certificates, students, degree_catalogue(keywords), scripted(), "2024-01-01").collect()}
    assert len(rows) == 6
    assert (rows[1].ai_decision, rows[1].credits_qualified, rows[1].company_validation_status) == ("ACCEPTED", 10.0, "NOT_LEGITIMATE")
    assert rows[1].calculation_breakdown.startswith("837 hours / 27 hours per ECTS = 31.0 credits, capped at 10.0")
    assert [i.severity for i in rows[1].issues_found] == ["high"]
    assert (rows[2].ai_decision, rows[2].credits_qualified) == ("REJECTED", 0.0)
    assert rows[2].issues_found[0].type == "name_mismatch"
    assert (rows[3].success, rows[3].error) == (False, "Text too short or empty")
    # the correction answers with credits and a decision, which hold; what it leaves out stays
    assert (rows[4].ai_decision, rows[4].corrected, rows[4].credits_qualified) == ("ACCEPTED", True, 12.0)
    assert (rows[4].total_working_hours, rows[4].ai_justification) == (837.0, "because")
    assert (rows[5].success, rows[5].error) == (False, "Evaluation failed: no answer")
    assert (rows[6].ai_decision, rows[6].name_validation_match_result) == ("ACCEPTED", "unknown")
    assert not rows[1].corrected


def test_corrections_that_do_not_hold(spark):
    """Credits over the limit, no object, or a failed call: the first answer stays."""
    certificates = spark.createDataFrame(
        [(i, 1, "PROFESSIONAL", f"an undecided certificate number {i}") for i in range(4)],
        "certificate_id int, student_id int, training_type string, text string")
    students = spark.createDataFrame([(1, "John", "Doe", "Business")], "student_id int, first_name string, last_name string, degree string")
    keywords = spark.createDataFrame([("general", "role", "clerk")], "programme_key string, kind string, keyword string")

    def correction():
        def call(prompt):
            if "number 0" in prompt:
                return '{"evaluation_results": {"credits_qualified": 31, "decision": "ACCEPTED"}}'
            if "number 1" in prompt:
                return "no object"
            if "number 2" in prompt:
                raise RuntimeError("overloaded")
            return '{"evaluation_results": {"total_working_hours": "540", "degree_relevance": "low", "decision": null}}'

        return call

    rows = {r.certificate_id: r for r in evaluate_with_model(
        certificates, students, degree_catalogue(keywords), {**scripted(), "correction": [("scripted", correction)]}, "2024-01-01").collect()}
    assert [rows[i].corrected for i in range(4)] == [False, False, False, True]
    assert {(r.ai_decision, r.credits_qualified) for r in rows.values()} == {("REJECTED", 30.0)}
    assert (rows[3].total_working_hours, rows[3].degree_relevance, rows[0].total_working_hours) == (540.0, "low", 837.0)


def test_positions_late_in_a_long_text(spark):
    late = "a long certificate " + "of many words " * 1000 + "Employer: Faraway Works, 1.2.2003 - 3.4.2005, 837 hours."
    assert late.index("Faraway") > 8000

    def extraction():
        def call(prompt):
            found = "Faraway Works" if "Employer: Faraway Works, 1.2.2003 - 3.4.2005, 837 hours." in prompt else ""
            return json.dumps({"employee_name": "John Doe", "employer": found, "employer_address": "Street 1",
                               "positions": [{"title": "t", "employer": found}] if found else []})

        return call

    certificates = spark.createDataFrame(
        [(1, 1, "GENERAL", late)], "certificate_id int, student_id int, training_type string, text string")
    students = spark.createDataFrame([(1, "John", "Doe", "Business")], "student_id int, first_name string, last_name string, degree string")
    keywords = spark.createDataFrame([("general", "role", "clerk")], "programme_key string, kind string, keyword string")
    callers = {**scripted(), "extraction": [("reader", extraction)]}

    def row(**limit):
        return evaluate_with_model(certificates, students, degree_catalogue(keywords), callers, "2024-01-01", **limit).collect()[0]

    whole = row()
    assert (whole.training_institution, whole.company_validation_status) == ("Faraway Works", "NOT_LEGITIMATE")
    assert row(limit=8000).training_institution != "Faraway Works"
