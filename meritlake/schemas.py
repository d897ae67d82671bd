"""Declared schemas; nothing is ever inferred."""

ENTITY_SCHEMAS = {
    "students": "student_id string, email string, degree string, first_name string, last_name string",
    "reviewers": (
        "reviewer_id string, email string, first_name string, last_name string, "
        "position string, department string"
    ),
    "certificates": (
        "certificate_id string, student_id string, training_type string, work_type string, "
        "filename string, filetype string, file_content binary, ocr_output string, "
        "uploaded_at timestamp"
    ),
    "decisions": (
        "decision_id string, certificate_id string, ai_justification string, ai_decision string, "
        "created_at timestamp, student_comment string, reviewer_id string, "
        "reviewer_decision string, reviewer_comment string, reviewed_at timestamp, "
        "total_working_hours int, credits_awarded int, training_duration string, "
        "training_institution string, degree_relevance string, supporting_evidence string, "
        "challenging_evidence string, recommendation string, ai_workflow_json string, "
        "company_validation_status string, company_validation_justification string, "
        "name_validation_match_result string, name_validation_explanation string"
    ),
    "additional_documents": (
        "document_id string, certificate_id string, document_type string, filename string, "
        "filetype string, file_content binary, ocr_output string, uploaded_at timestamp"
    ),
}

POSITION = (
    "struct<title:string,employer:string,start_date:string,end_date:string,duration:string,"
    "responsibilities:string>"
)
EXTRACTION = (
    "struct<employee_name:string,employer:string,certificate_issue_date:string,"
    f"positions:array<{POSITION}>,total_employment_period:string,document_language:string,"
    "confidence_level:string>"
)
EVALUATION = (
    "struct<total_working_hours:int,requested_training_type:string,credits_calculated:double,"
    "credits_qualified:double,degree_relevance:string,relevance_explanation:string,"
    "calculation_breakdown:string,summary_justification:string,decision:string,"
    "justification:string,recommendation:string,supporting_evidence:string,"
    "challenging_evidence:string>"
)
ISSUE = (
    "struct<type:string,severity:string,description:string,field_affected:string,"
    "suggestion:string,position_index:int>"
)
COMPANY = (
    "struct<name:string,status:string,confidence:string,risk_level:string,justification:string,"
    "supporting_evidence:array<string>,requires_review:boolean>"
)
COMPANY_ANSWER = (
    "struct<status:string,confidence:string,risk_level:string,justification:string,"
    "supporting_evidence:array<string>,requires_review:boolean>"
)
VALIDATION = (
    "struct<validation_passed:boolean,overall_accuracy_score:double,"
    f"issues_found:array<{ISSUE}>,"
    f"company_validation:struct<status:string,companies:array<{COMPANY}>>,"
    "name_validation:struct<match_result:string,match_confidence:double,explanation:string>,"
    "summary:string,requires_correction:boolean>"
)
STAGE = "struct<success:boolean,error:string,results:{results}>"
WORKFLOW = (
    "struct<success:boolean,error:string,"
    f"extraction_results:{STAGE.format(results=EXTRACTION)},"
    f"evaluation_results:{STAGE.format(results=EVALUATION)},"
    f"validation_results:struct<success:boolean,error:string,results:{VALIDATION},"
    f"company_validation:struct<status:string,companies:array<{COMPANY}>>>,"
    f"correction_results:{STAGE.format(results='struct<evaluation_results:' + EVALUATION + '>')}>"
)
