"""The entity tables as views over the given test tables.

One text per view, in the SQL both engines share: Spark runs it to feed the operators,
the comparison engine runs it in front of its own query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from meritlake.sources.tables import spread_few_splits

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
EMAIL_DOMAIN = "students.example.org"

VIEWS: dict[str, str] = {
    "students": f"""
        SELECT c_custkey AS student_id,
          lower(replace(c_name, '#', '.')) || '@{EMAIL_DOMAIN}' AS email,
          CASE c_mktsegment WHEN 'MACHINERY' THEN 'bachelor of engineering, mechanical engineering'
            WHEN 'BUILDING' THEN 'Rakennusmestari (AMK)!' WHEN 'AUTOMOBILE' THEN 'Business'
            WHEN 'HOUSEHOLD' THEN 'sosionomi_amk' ELSE 'Unlisted Studies' END AS degree,
          CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE split_part(c_name, '#', 1) END AS first_name,
          split_part(c_name, '#', 2) AS last_name
        FROM customer""",
    "reviewers": """
        SELECT s_suppkey AS reviewer_id,
          lower(replace(s_name, '#', '.')) || '@staff.example.org' AS email,
          CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE split_part(s_name, '#', 1) END AS first_name,
          split_part(s_name, '#', 2) AS last_name,
          CASE WHEN s_acctbal > 0 THEN 'Lecturer' ELSE 'Head' END AS position,
          n_name AS department
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "certificates": """
        SELECT o_orderkey AS certificate_id, o_custkey AS student_id,
          CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'PROFESSIONAL'
            ELSE 'GENERAL' END AS training_type,
          CASE WHEN o_orderstatus = 'P' THEN 'SELF_PACED' ELSE 'REGULAR' END AS work_type,
          'certificate_' || CAST(o_orderkey AS STRING) || CASE substr(o_orderpriority, 1, 1)
            WHEN '1' THEN '.PDF' WHEN '2' THEN '.docx' WHEN '3' THEN '.png' WHEN '4' THEN '.jpeg'
            ELSE '.doc' END AS filename,
          CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pdf' WHEN '2' THEN 'docx'
            WHEN '3' THEN 'png' WHEN '4' THEN 'jpeg' ELSE 'doc' END AS filetype,
          CAST(o_orderdate AS TIMESTAMP) AS uploaded_at
        FROM orders""",
    "positions": """
        SELECT l_orderkey AS certificate_id, l_linenumber AS line, l_partkey AS part_id,
          l_suppkey AS supplier_id, p_type AS title, p_name AS duties,
          CASE WHEN l_discount = 0 THEN NULL ELSE s_name END AS employer,
          CAST(l_shipdate AS DATE) AS start_date,
          CASE WHEN l_tax = 0 THEN NULL
            ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity * 7 AS INT) END AS end_date
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "decisions": """
        SELECT 'D' || CAST(l_orderkey AS STRING) AS decision_id, l_orderkey AS certificate_id,
          'Evaluated ' || CAST(count(*) AS STRING) || ' positions' AS ai_justification,
          CASE WHEN min(l_returnflag) = 'A' THEN 'ACCEPTED' ELSE 'REJECTED' END AS ai_decision,
          CAST(max(l_shipdate) AS TIMESTAMP) AS created_at,
          CASE WHEN count(*) % 3 = 0 THEN 'Please look again at ' || CAST(l_orderkey AS STRING) END
            AS student_comment,
          CASE WHEN min(l_linestatus) = 'F' AND max(l_linestatus) = 'O' THEN max(l_suppkey) END
            AS reviewer_id,
          CASE WHEN min(l_linestatus) = 'F' AND max(l_linestatus) = 'O' THEN
            CASE WHEN max(l_returnflag) = 'N' THEN 'FAIL' WHEN min(l_returnflag) = 'A' THEN 'PASS' END
            END AS reviewer_decision,
          CASE WHEN min(l_linestatus) = 'F' AND max(l_linestatus) = 'O' AND max(l_returnflag) = 'N'
            THEN 'Not enough evidence' END AS reviewer_comment,
          CASE WHEN min(l_linestatus) = 'F' AND max(l_linestatus) = 'O' AND
            (max(l_returnflag) = 'N' OR min(l_returnflag) = 'A')
            THEN CAST(max(l_shipdate) + INTERVAL 7 DAY AS TIMESTAMP) END AS reviewed_at,
          CAST(sum(l_quantity) * 8 AS INT) AS total_working_hours,
          CAST(least(floor(sum(l_quantity) * 8 / 27), 30) AS INT) AS credits_awarded,
          CAST(count(*) AS STRING) || ' months' AS training_duration,
          'Employer ' || CAST(min(l_suppkey) AS STRING) AS training_institution,
          CASE max(l_linenumber) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END
            AS degree_relevance,
          'Worked in ' || CAST(count(*) AS STRING) || ' places' AS supporting_evidence,
          CAST(NULL AS STRING) AS challenging_evidence,
          CASE WHEN min(l_returnflag) = 'A' THEN '' ELSE 'Apply for general training' END
            AS recommendation,
          '{"success":true}' AS ai_workflow_json,
          CASE WHEN max(l_tax) > 0.07 THEN 'UNVERIFIED' ELSE 'LEGITIMATE' END
            AS company_validation_status,
          CAST(NULL AS STRING) AS company_validation_justification,
          CASE WHEN min(l_discount) = 0 THEN 'mismatch' WHEN max(l_discount) > 0.09 THEN 'match' END
            AS name_validation_match_result,
          CASE WHEN min(l_discount) = 0 THEN 'Names do not match' WHEN max(l_discount) > 0.09
            THEN 'Exact match' END AS name_validation_explanation
        FROM lineitem GROUP BY l_orderkey""",
    "additional_documents": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
            || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-'
            || CAST(CAST(l_quantity AS INT) AS STRING) || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING)
            AS document_id,
          l_orderkey AS certificate_id,
          CASE WHEN l_returnflag = 'R' THEN 'PROJECT_DETAILS' ELSE 'HOUR_DOCUMENTATION' END
            AS document_type,
          'hours_' || CAST(l_linenumber AS STRING) || CASE l_returnflag WHEN 'A' THEN '.pdf'
            WHEN 'N' THEN '.txt' ELSE '' END AS filename,
          CASE l_returnflag WHEN 'A' THEN 'pdf' ELSE 'txt' END AS filetype,
          'Worked ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' hours' AS ocr_output,
          CAST(l_quantity AS INT) AS hours,
          CAST(l_extendedprice * 150 AS BIGINT) AS size,
          CAST(l_shipdate AS TIMESTAMP) AS uploaded_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'""",
    # one extraction per certificate; the employee is written in six ways
    "extractions": """
        SELECT o_orderkey AS certificate_id,
          CASE o_orderkey % 6 WHEN 0 THEN split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2)
            WHEN 1 THEN split_part(c_name, '#', 2) || ', ' || upper(split_part(c_name, '#', 1))
            WHEN 2 THEN 'Jane Smith' WHEN 3 THEN 'Ms. ' || split_part(c_name, '#', 1) || ' Korhonen'
            WHEN 4 THEN 'Kustomer ' || split_part(c_name, '#', 2)
            ELSE NULL END AS employee_name,
          CAST(o_orderdate AS DATE) + 200 AS issue_date,
          'Worked with ' || c_mktsegment || ' as ' || o_orderpriority || ', tasks: '
            || CASE o_orderkey % 4 WHEN 0 THEN 'economy widget and red bolt' WHEN 1 THEN 'small gear'
               WHEN 2 THEN 'promo ring, large plate' ELSE 'none' END AS duties
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    # documents with planted certificate sentences in front of the whole text
    "texts": """
        SELECT doc_id, lang, source, CASE doc_id % 4
          WHEN 0 THEN 'Date: 5. 7. 2021' || chr(10) || 'This is to certify that Mr. Matti ' ||
            CASE doc_id % 3 WHEN 0 THEN 'Virtanen' WHEN 1 THEN 'Koskinen' ELSE 'Mäkelä' END ||
            ' has worked at Nordic Metal Oy from 1.2.2020 to 30.6.2021, 20 hours/week, 20-30 ECTS.' || chr(10)
          WHEN 1 THEN 'Työtodistus' || chr(13) || chr(10) || chr(13) || chr(10) || '27.11.2009' || chr(10) ||
            'Tämä todistaa, että Pekka Korhonen on toiminut yrityksessä Pohjola Terminal Oyj 13.2.1984 – 30.9.2009 ja 5.2.2007 - 31.2.2009. 50% työaika, 15 op.'
            || chr(10) || chr(9) || '  x ' || chr(10) || chr(10) || chr(10) || chr(10)
          WHEN 2 THEN 'ThisIsA Certificate of5 years fromJanuary2020to5March atUniversity MrSmith completedHisInternship 1n ABTechnologies Dr.Who    spaced'
            || chr(9) || 'out since 2020-01-15 at Acme Group. '
          ELSE '' END || text AS text
        FROM documents""",
    # raw extraction answers: fenced, single-quoted, bare keys, truncated, chatty
    "answers": """
        SELECT certificate_id, CASE certificate_id % 6
          WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```'
          WHEN 1 THEN replace(j, '"', chr(39))
          WHEN 2 THEN replace(replace(replace(j, '"employee_name"', 'employee_name'), '"positions"',
            'positions'), '}]', '},]')
          WHEN 3 THEN substr(j, 1, length(j) - 30)
          WHEN 4 THEN CASE WHEN certificate_id % 12 = 4 THEN NULL ELSE 'no object here' END
          ELSE 'Sure: ' || j || ' Done.' END AS answer
        FROM (SELECT o_orderkey AS certificate_id, '{"employee_name": ' || CASE WHEN o_orderkey % 10 = 5
            THEN 'null' ELSE '"Customer ' || CAST(o_custkey AS STRING) || '"' END
            || ', "employer": "Works ' || CAST(o_orderkey % 100 AS STRING)
            || '", "certificate_issue_date": "' || CAST(CAST(o_orderdate AS DATE) AS STRING)
            || '", "positions": [{"title": null, "employer": "Works A", "start_date": "2. 6. 1999", "end_date": "31.2.2000"}, "noise", {"title": "Welder", "start_date": "1999-6-2", "end_date": "1/7/2000"}], "total_employment_period": "2 years", "document_language": '
            || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '"en"' END || '}' AS j FROM orders) AS a""",
    # evaluation answers in five spellings
    "evaluation_answers": """
        SELECT o_orderkey AS certificate_id, CASE o_orderkey % 5
          WHEN 0 THEN '{"Total Working Hours": ' || CAST(o_orderkey AS STRING) || ', "Academic Credits": 11, "Degree Relevance": "'
            || CASE o_orderkey % 4 WHEN 0 THEN 'Not directly related to the degree' WHEN 1 THEN 'Directly related, high match'
               WHEN 2 THEN 'Somewhat related' ELSE 'Unclear' END
            || '", "Recommendation": "Accept as general training", "requested_training_type": "'
            || CASE WHEN o_orderkey % 2 = 0 THEN 'professional' ELSE 'general' END
            || '", "Evidence Analysis": {"for_professional_training": "good tasks", "against_professional_training": "short"}}'
          WHEN 1 THEN '{"total_working_hours": ' || CAST(o_orderkey * 3 AS STRING)
            || ', "decision": "ACCEPTED", "justification": {"justification": "inner text", "score": 1}, "degree_relevance": "high"}'
          WHEN 2 THEN '{"recommendation": "' || CASE o_orderkey % 3 WHEN 0 THEN 'Reject it' WHEN 1 THEN 'Please approve'
            ELSE 'General work only' END || '", "requested_training_type": "professional", "supporting_evidence": "own"}'
          WHEN 3 THEN '{"Decision": null, "Justification": "No justification provided", "Recommendation": "Approve professional training"}'
          ELSE '{"total_working_hours": "1040 hours", "justification": ["a","b"], "evidence_analysis": "text only", "credits_qualified": 4.5}'
          END AS answer
        FROM orders""",
    # company answers: paragraph, object, wrapped object, broken object, nothing usable
    "company_answers": """
        SELECT doc_id, CASE doc_id % 6
          WHEN 0 THEN 'The company website and the business registry were found; address match. ' || text
          WHEN 1 THEN '{"status": "NOT_LEGITIMATE", "confidence": "low", "supporting_evidence": ["'
            || lang || '", "x"], "requires_review": true}'
          WHEN 2 THEN 'Result: {"status": "UNVERIFIED", "risk_level": "medium", "justification": "'
            || source || '"} as asked'
          WHEN 3 THEN '{"status": "LEGITIMATE" broken} ' || text
          WHEN 4 THEN CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '["a list"]' ELSE '42' END
          ELSE 'Suspicious email and invalid phone, in the latest news. ' || text END AS answer
        FROM documents""",
    "verdict_answers": """
        SELECT s_name AS employer, CASE s_suppkey % 4
          WHEN 0 THEN '{"status": "LEGITIMATE", "confidence": "high"}'
          WHEN 1 THEN '{"status": "NOT_LEGITIMATE", "confidence": "low"}'
          WHEN 2 THEN '{"status": "UNVERIFIED"}' ELSE NULL END AS answer
        FROM supplier""",
    # nested workflow documents
    "workflows": """
        SELECT certificate_id, '{"success":true,"extraction_results":{"success":true,"results":{"employer":"'
          || training_institution || '","total_employment_period":' ||
          CASE WHEN total_working_hours % 3 = 0 THEN 'null' ELSE '"' || training_duration || '"' END
          || '}},"evaluation_results":{"success":true,"results":{"decision":"' ||
          CASE WHEN total_working_hours % 5 = 0 THEN 'PENDING' ELSE ai_decision END
          || '","justification":"' || ai_justification || '","total_working_hours":' ||
          CAST(total_working_hours AS STRING) || ',"credits_qualified":' ||
          CAST(credits_awarded AS STRING) || '.0,"degree_relevance":"' || degree_relevance
          || '"}},"validation_results":{"success":' ||
          CASE WHEN total_working_hours % 11 = 0 THEN 'false' ELSE 'true' END
          || ',"results":{"requires_correction":' ||
          CASE WHEN total_working_hours % 2 = 0 THEN 'true' ELSE 'false' END
          || ',"issues_found":[' ||
          CASE WHEN credits_awarded > 20 THEN '{"type":"business_rule","severity":"high","description":"many credits","field_affected":"credits_qualified","suggestion":"check"},'
            || '{"type":"date_validation","severity":"low","description":"old dates","field_affected":"positions","suggestion":"look","position_index":1}'
            WHEN credits_awarded > 10 THEN '{"type":"data_type","severity":"medium","description":"text","field_affected":"employer","suggestion":"none"}'
            ELSE '' END
          || '],"company_validation":{"status":"' || company_validation_status || '","companies":[' ||
          CASE WHEN company_validation_status = 'LEGITIMATE' THEN '{"name":"' || training_institution
            || '","status":"LEGITIMATE","confidence":"high"}' ELSE '' END
          || ']}' ||
          CASE WHEN name_validation_match_result IS NULL THEN '' ELSE ',"name_validation":{"match_result":"'
            || name_validation_match_result || '","explanation":"' || name_validation_explanation || '"}' END
          || '}},"correction_results":' ||
          CASE total_working_hours % 4 WHEN 0 THEN 'null'
            ELSE '{"success":true,"results":{"evaluation_results":{"decision":"ACCEPTED","credits_qualified":'
            || CAST(total_working_hours % 40 AS STRING) || '.0}}}' END
          || '}' AS ai_workflow_json
        FROM decisions""",
    # events as reviewer and student actions
    "actions": """
        SELECT event_id AS action_id, CAST(ts AS TIMESTAMP) AS action_at,
          CASE WHEN value < 2 THEN -1 - user_id ELSE user_id * 3 END AS certificate_id,
          event_type,
          CASE WHEN value > 60 THEN 'pass' WHEN value > 8 THEN 'FAIL' ELSE 'MAYBE' END AS reviewer_decision,
          'Review ' || CAST(event_id AS STRING) AS reviewer_comment,
          CASE WHEN value > 20 THEN 'Comment ' || CAST(event_id AS STRING) END AS student_comment,
          CASE WHEN value < 50 THEN event_id % 10 END AS reviewer_id
        FROM events""",
    # raw pages as uploads of every admissible and inadmissible kind
    "uploads": """
        SELECT page_id AS upload_id,
          CASE page_id % 7 WHEN 0 THEN 'general' WHEN 1 THEN 'PROFESSIONAL' WHEN 6 THEN 'other'
            ELSE 'General' END AS training_type,
          CASE page_id % 11 WHEN 5 THEN 'weekly' WHEN 6 THEN 'self_paced' ELSE 'REGULAR' END AS work_type,
          CASE page_id % 9 WHEN 0 THEN 'page.PDF' WHEN 1 THEN 'a.b.docx' WHEN 2 THEN 'noext'
            WHEN 3 THEN 'x.exe' WHEN 4 THEN '' WHEN 5 THEN NULL
            ELSE 'scan_' || CAST(page_id AS STRING) || '.tiff' END AS filename,
          CASE WHEN page_id % 5 = 3 THEN 0 ELSE CAST(length(html) AS BIGINT) * 3000 END AS size
        FROM pages""",
    "keywords": """
        SELECT DISTINCT programme_no, kind, keyword FROM (
          SELECT p_partkey % 36 AS programme_no, 'role' AS kind, p_name AS keyword FROM part
          UNION ALL SELECT p_partkey % 36, 'industry', p_type FROM part) AS k""",
}


def _needed(sql: str) -> list[str]:
    """Views a text names, each after the ones it builds on."""
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for name in dict.fromkeys(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", text)):
            if name in VIEWS and name not in seen and name not in order:
                visit(VIEWS[name], (*seen, name))
                order.append(name)

    visit(sql, ())
    return order


def with_views(sql: str) -> str:
    """A query with the views it uses in front."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in _needed(sql)]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Tables:
    """Base tables and views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, heavy: bool = False) -> None:
        self.spark, self.folder, self.heavy = spark, folder.rstrip("/"), heavy
        self._read: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._read:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            self._read[name] = spread_few_splits(table) if self.heavy else table
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name not in VIEWS:
            raise AttributeError(name)
        sql = with_views(f"SELECT * FROM {name}")
        for table in BASE_TABLES:
            if re.search(rf"\b{table}\b", sql):
                self.base(table).createOrReplaceTempView(table)
        return self.spark.sql(sql)
