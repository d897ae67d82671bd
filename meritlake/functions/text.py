"""Text columns. Everything is a built-in expression, so scans stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlake import constants as K
from meritlake.functions.binding import let


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind, not only spaces."""
    return F.btrim(text, F.lit(K.STRIP_CHARS))


def _kept_lines(text: Column, breaks: str, min_length: int) -> Column:
    lines = F.transform(F.split(text, breaks), strip)
    return F.array_join(F.filter(lines, lambda line: F.length(line) >= min_length), "\n")


def clean_text(text: Column) -> Column:
    """Trim lines and drop empty ones, splitting at any line break."""
    return _kept_lines(text, K.LINE_BREAK_CLASS, 1)


def clean_ocr_text(text: Column) -> Column:
    """Trim lines and drop those of at most two characters, splitting at newlines only."""
    return F.coalesce(_kept_lines(text, "\n", 3), F.lit(""))


def sanitize_text(text: Column, limit: int | None = K.PROMPT_TEXT_LIMIT) -> Column:
    """Text as a prompt takes it: no control characters, one space, no empty lines, cut at ``limit`` (None: whole).

    Empty lines vanish altogether, so squeezing runs of newlines first would change nothing.
    """
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    plain = F.replace(F.replace(plain, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # single spaces stay as they are, so only texts with longer runs meet the pattern
    plain = let(plain, lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, " {2,}", " ")).otherwise(t))
    plain = _kept_lines(plain, "\n", 1)
    if limit is None:
        # the lines have no white space at their ends, nor has the whole
        return F.coalesce(plain, F.lit(""))
    cut = let(plain, lambda t: F.when(
        F.length(t) > limit,
        F.concat(F.substring(t, 1, limit), F.lit(K.TRUNCATION_MARKER)),
    ).otherwise(t))
    return F.coalesce(strip(cut), F.lit(""))


def input_problem(text: Column) -> Column:
    """Why a text cannot be evaluated, or null."""
    # the end does not matter here, and finding it would read the whole text
    stripped = F.ltrim(text, F.lit(K.STRIP_CHARS))
    return (
        F.when(text.isNull(), F.lit("Invalid text input: <class 'NoneType'>"))
        .when(text == "", F.lit("Invalid text input: <class 'str'>"))
        .when((F.length(text) < 10) | (stripped == ""), F.lit("Text too short or empty"))
        .when(
            stripped.startswith('"') | stripped.startswith("{"),
            F.lit("Text appears to be JSON, not document content"),
        )
    )


def fix_word_spacing(text: Column) -> Column:
    """Re-insert spaces that text recognition lost. The rules run in their listed order."""
    fixed = text
    for pattern in K.SPACING_PATTERNS:
        fixed = F.regexp_replace(fixed, pattern, "$1 $2")
    fixed = F.regexp_replace(fixed, r"(?U)[\s\x1c-\x1f]+", " ")
    for wrong, right in K.SPACING_FIXES:
        fixed = F.replace(fixed, F.lit(wrong), F.lit(right))
    return strip(fixed)


def _language_pattern(keywords: tuple[str, ...]) -> str:
    """One alternation; a keyword holding a Finnish letter is found by the letter already."""
    plain = [word for word in keywords if not set(word) & set(K.FINNISH_LETTERS)]
    return "|".join([f"[{K.FINNISH_LETTERS}]", *plain])


def detect_language(text: Column, keywords: tuple[str, ...] = K.WORKFLOW_KEYWORDS) -> Column:
    """'fin' when the text has a Finnish letter or keyword, 'eng' when not, 'auto' when empty."""
    return (
        F.when(text.isNull() | (text == ""), F.lit("auto"))
        .when(F.lower(text).rlike(_language_pattern(keywords)), F.lit("fin"))
        .otherwise(F.lit("eng"))
    )


def diacritic_count(text: Column) -> Column:
    lowered = F.lower(text)
    return F.length(lowered) - F.length(F.translate(lowered, K.FINNISH_LETTERS, ""))


def text_confidence(suffix: Column, language: Column, finnish_detection: bool = True) -> Column:
    """Confidence of extracted text from its language and file type, at most 1."""
    finnish_bonus = 0.1 if finnish_detection else 0.0
    score = (
        F.lit(0.8)
        + F.when(language == "fin", F.lit(finnish_bonus))
        .when(language == "eng", F.lit(0.05))
        .otherwise(F.lit(0.0))
        + F.when(F.lower(suffix).isin("pdf", "docx", ".pdf", ".docx"), F.lit(0.05)).otherwise(F.lit(0.0))
    )
    return F.least(score, F.lit(1.0))


def confidence_band(percent: Column) -> Column:
    return (
        F.when(percent >= 80, F.lit("high"))
        .when(percent >= 50, F.lit("medium"))
        .when(percent.isNotNull(), F.lit("low"))
    )


def suffix_of(filename: Column) -> Column:
    """Lower-case extension without the dot; '' when there is none.

    Leading dots belong to the name, as in ``.profile``.
    """
    base = F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"^\.+", "")
    return F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))


def media_type(filetype: Column) -> Column:
    kind = F.lower(filetype)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffix, mime in K.MEDIA_TYPES.items():
        chain = chain.when(kind == suffix, F.lit(mime))
    return chain.otherwise(F.lit(K.DEFAULT_MEDIA_TYPE))


def redacted(text: Column) -> Column:
    return F.concat(F.lit("["), F.length(text).cast("string"), F.lit(" characters]"))


def redact_for_output(document: Column, field: str = "extracted_text") -> Column:
    """Replace the long text inside a result struct by its length."""
    return document.withField(field, redacted(document[field]))


def render_template(template: str, values: dict[str, Column], missing: str = "") -> Column:
    """Fill ``{name}`` places of a template from columns; null becomes ``missing``.

    ``{{`` and ``}}`` stand for plain braces. The template is taken apart once, while the
    plan is built; rows only see one ``concat``.
    """
    parts: list[Column] = []
    for token in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if not token:
            continue
        if token in ("{{", "}}"):
            parts.append(F.lit(token[0]))
        elif token[0] == "{":
            parts.append(F.coalesce(values[token[1:-1]].cast("string"), F.lit(missing)))
        else:
            parts.append(F.lit(token))
    return F.concat(*parts)


# Own short wordings; a caller may pass any other text with the same places.
PROMPT_TEMPLATES = {
    "extraction": (
        "List employee, employer, issue date and positions of this certificate as JSON.\n\n"
        "{document_text}"
    ),
    "evaluation": (
        "Today is {current_date}. Degree: {student_degree}. Requested: {requested_training_type}.\n"
        "{degree_specific_guidelines}\n{additional_documents_section}\nFields: {extracted_info}\n"
        "Text: {document_text}\n{additional_documents_text}\nAnswer with one JSON object."
    ),
    "validation": (
        "Today is {current_date}. Check these results against the text.\nText: {ocr_text}\n"
        "Extraction: {extraction_results}\nEvaluation: {evaluation_results}\n"
        "Degree: {student_degree}. Requested: {requested_training_type}."
    ),
    "correction": (
        "Today is {current_date}. Correct the results.\nText: {ocr_text}\n"
        "Extraction: {extraction_results}\nEvaluation: {evaluation_results}\n"
        "Findings: {validation_results}\nDegree: {student_degree}. "
        "Requested: {requested_training_type}."
    ),
    "company": (
        "Is this company real? Name: {company_name}. Address: {address}. "
        "Business id: {business_id}. Phone: {phone}. Email: {email}."
    ),
}

GUIDELINE_TEMPLATE = (
    "GUIDELINES FOR {upper_name}\n"
    "RELEVANT INDUSTRIES: {industries}\n"
    "RELEVANT ROLES: {roles}\n"
    "Compare tasks, industry and skills with the {name} curriculum. Practical training is 30 "
    "credits: professional work at least 20, general work at most 10."
)


def degree_guidelines(name: Column, industries: Column, roles: Column,
                      template: str = GUIDELINE_TEMPLATE) -> Column:
    return render_template(template, {
        "upper_name": F.upper(name),
        "name": name,
        "industries": F.array_join(industries, ", "),
        "roles": F.array_join(roles, ", "),
    })
