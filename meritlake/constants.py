"""Every list, message and limit that decides a result."""

# --- Entity domains (fixed values) -------------------------------------------------
TRAINING_TYPES = ("GENERAL", "PROFESSIONAL")
WORK_TYPES = ("REGULAR", "SELF_PACED")
DECISION_STATUSES = ("ACCEPTED", "REJECTED")
DOCUMENT_TYPES = ("HOUR_DOCUMENTATION", "PROJECT_DETAILS")
REVIEWER_DECISIONS = ("PASS", "FAIL")
COMPANY_STATUSES = ("LEGITIMATE", "NOT_LEGITIMATE", "PARTIALLY_LEGITIMATE", "UNVERIFIED")
NAME_MATCH_RESULTS = ("match", "partial_match", "mismatch", "unknown")
RELEVANCE_LEVELS = ("high", "medium", "low")

# --- Credits and limits (fixed values) ----------------------------------------------
HOURS_PER_CREDIT = 27
CREDIT_CAPS = {"professional": 30, "general": 10}
MAX_CREDITS = 30
MAX_WORKING_HOURS = 100000
CERTIFICATES_ALLOWED = {"GENERAL": 1, "PROFESSIONAL": 2}
LIMIT_MESSAGES = {
    "GENERAL": "Student already has 1 general training certificate (maximum allowed)",
    "PROFESSIONAL": "Student already has 2 professional training certificates (maximum allowed)",
}
FULL_TIME_WEEK_HOURS = 40
MAX_GAP_DAYS = 3650
DAYS_PER_YEAR = 365.25
PROMPT_TEXT_LIMIT = 8000
TRUNCATION_MARKER = "\n\n[Text truncated due to length]"
DIGEST_TEXT_LIMIT = 500

# --- Uploads (fixed values) ----------------------------------------------------------
UPLOAD_SUFFIXES = ("pdf", "docx", "doc", "png", "jpg", "jpeg", "tiff", "bmp")
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "doc": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"

# --- Characters Python's str.strip() and str.splitlines() act on (fixed values) -------
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK_CLASS = r"[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# --- Finnish language marks (fixed values) --------------------------------------------
FINNISH_LETTERS = "äöå"
WORKFLOW_KEYWORDS = (
    "työtodistus", "todistus", "yrityksessämme", "välisenä", "tehtävissä", "työntekijä",
    "työnantaja", "päivämäärä", "nimi", "syntynyt", "ammatti", "tehtävä", "osasto",
    "palvelussuhde", "harjoittelu", "koulutus", "oppilaitos", "yliopisto", "koulu",
)
OCR_KEYWORDS = (
    "työtodistus", "todistus", "työntekijä", "työnantaja", "päivämäärä", "nimi", "syntynyt",
    "ammatti", "tehtävä", "osasto", "palvelussuhde", "harjoittelu", "koulutus", "oppilaitos",
    "yliopisto", "koulu",
)

# --- Word spacing: ordered (pattern, replacement) rules and literal fixes (fixed values)
SPACING_PATTERNS = (
    r"([a-z])([A-Z])",
    r"([a-zA-Z])(\d)",
    r"(\d)([a-zA-Z])",
    r"([a-z])(Certificate|Experience|Internship|University|Technologies|Ltd|Mr|Ms|Date|This"
    r"|That|The|And|Has|Was|Is|To|At|In|On|With|From|For)",
    r"(to|is|of|at|in|on|the|and|has|was|for|with|from|that|this)([A-Z][a-z])",
    r"([a-z])(successfully|completed|employed|designated)",
    r"(Mr|Ms|Dr)([A-Z])",
    r"(\d{4})(to|from)",
    r"(to|from)(\d)",
    r"([A-Z]{2,})([A-Z][a-z])",
)
SPACING_FIXES = (
    ("1s", "is"), ("1n", "in"), ("0f", "of"), ("Mr.", "Mr "), ("Ms.", "Ms "), ("Dr.", "Dr "),
)

# --- Evaluation answers: name in the answer -> field it fills, in this order (fixed values)
EVALUATION_ALIASES = (
    ("Total Working Hours", "total_working_hours"),
    ("Academic Credits", "credits_calculated"),
    ("credits_calculated", "credits_calculated"),
    ("total_working_hours", "total_working_hours"),
    ("Justification", "justification"),
    ("justification", "justification"),
    ("Degree Relevance", "relevance_explanation"),
    ("degree_relevance", "relevance_explanation"),
    ("Relevance Explanation", "relevance_explanation"),
    ("relevance_explanation", "relevance_explanation"),
    ("Calculation Breakdown", "calculation_breakdown"),
    ("Summary Justification", "summary_justification"),
    ("Recommendation", "justification"),
    ("recommendation", "justification"),
    ("Nature of Tasks", "nature_of_tasks"),
    ("nature_of_tasks", "nature_of_tasks"),
    ("Training Type Analysis", "training_type_analysis"),
    ("training_type_analysis", "training_type_analysis"),
    ("Evidence Analysis", "evidence_analysis"),
    ("evidence_analysis", "evidence_analysis"),
    ("Hour Verification Details", "hour_verification_details"),
    ("Hour Verification Method", "hour_verification_method"),
    ("Additional Documents Used", "additional_documents_used"),
    ("Additional Document Hours", "additional_document_hours"),
    ("Hour Calculation", "hour_calculation"),
    ("Discrepancies Found", "discrepancies_found"),
    ("Reason for Using Additional Documents", "reason_for_using_additional_documents"),
)
EVALUATION_TEXT_DEFAULTS = {
    "degree_relevance": "low",
    "relevance_explanation": "No explanation provided",
    "calculation_breakdown": "No calculation breakdown provided",
    "summary_justification": "No summary justification provided",
}
NO_JUSTIFICATION = "No justification provided"
# ordered (level, phrases) rules for free-text relevance (fixed values)
RELEVANCE_RULES = (
    ("low", ("not directly related", "not related", "falls outside", "does not align")),
    ("high", ("high", "directly related", "closely related")),
    ("medium", ("medium", "somewhat related", "partially related")),
)

# --- Extraction fallback (fixed values) -------------------------------------------------
FALLBACK_NOTE = "Partial JSON parsed, some fields may be missing"

# --- Company answers (fixed values) ------------------------------------------------------
SUSPICIOUS_WORDS = ("suspicious", "fake", "test", "sample", "invalid", "reject")
POSITIVE_WORDS = ("legitimate", "valid", "real", "accept", "good", "professional")
DEFAULT_COMPANY_EVIDENCE = (
    "Company website found",
    "Business registry information found",
    "Address verification completed",
    "Industry information verified",
)

# --- Degree programmes: (key, name) in list order (fixed values) -------------------------
DEGREE_PROGRAMMES = (
    ("bachelor_of_engineering_information_technology",
     "Bachelor of Engineering (BEng), Information Technology"),
    ("insinoori_tieto_ja_viestintatekniikka", "Insinööri (AMK), tieto- ja viestintätekniikka"),
    ("tradenomi_tietojenkasittely", "Tradenomi (AMK), tietojenkäsittely"),
    ("bachelor_of_business_administration_international_business",
     "Bachelor of Business Administration (BBA), International Business"),
    ("tradenomi_liiketalous", "Tradenomi (AMK), liiketalous"),
    ("tradenomi_liiketalous_verkkokoulutus", "Tradenomi (AMK), liiketalous, verkkokoulutus"),
    ("medianomi_amk", "Medianomi (AMK)"),
    ("musiikkipedagogi_amk", "Musiikkipedagogi (AMK)"),
    ("tanssinopettaja_amk", "Tanssinopettaja (AMK)"),
    ("agrologi_maaseutuelinkeinot", "Agrologi (AMK), maaseutuelinkeinot"),
    ("bachelor_of_health_care_nursing", "Bachelor of Health Care, Nursing"),
    ("bioanalyytikko_amk", "Bioanalyytikko (AMK)"),
    ("ensihoitaja_amk", "Ensihoitaja (AMK)"),
    ("fysioterapeutti_amk", "Fysioterapeutti (AMK)"),
    ("katilo_amk", "Kätilö (AMK)"),
    ("hammashoitaja_amk", "Hammashoitaja (AMK)"),
    ("kuntoutuksen_ohjaaja_amk", "Kuntoutuksen ohjaaja (AMK)"),
    ("laboratoriohoitaja_amk", "Laboratoriohoitaja (AMK)"),
    ("optometristi_amk", "Optometristi (AMK)"),
    ("rontgenhoitaja_amk", "Röntgenhoitaja (AMK)"),
    ("sairaanhoitaja_amk", "Sairaanhoitaja (AMK)"),
    ("sosionomi_amk", "Sosionomi (AMK)"),
    ("suuhygienisti_amk", "Suuhygienisti (AMK)"),
    ("toimintaterapeutti_amk", "Toimintaterapeutti (AMK)"),
    ("sosiaali_ja_terveysalan_johtaja_amk", "Sosiaali- ja terveysalan johtaja (AMK)"),
    ("terveydenhoitaja_amk", "Terveydenhoitaja (AMK)"),
    ("bachelor_of_engineering_energy_and_environmental_engineering",
     "Bachelor of Engineering, Energy and Environmental Engineering"),
    ("bachelor_of_engineering_mechanical_engineering",
     "Bachelor of Engineering, Mechanical Engineering"),
    ("insinoori_energia_ja_ymparistotekniikka",
     "Insinööri (AMK), energia- ja ympäristötekniikka"),
    ("insinoori_amk_konetekniikka", "Insinööri (AMK), konetekniikka"),
    ("insinoori_amk_sahko_ja_automaatiotekniikka",
     "Insinööri (AMK), sähkö- ja automaatiotekniikka"),
    ("insinoori_amk_talotekniikka", "Insinööri (AMK), talotekniikka"),
    ("insinoori_amk_rakennus_ja_yhdyskuntatekniikka",
     "Insinööri (AMK), rakennus- ja yhdyskuntatekniikka"),
    ("rakennusarkkitehti_amk", "Rakennusarkkitehti (AMK)"),
    ("rakennusmestari_amk", "Rakennusmestari (AMK)"),
    ("general", "General Studies"),
)
GENERAL_FIELDS = ("Liberal Arts", "General Studies", "Interdisciplinary Studies")

# --- Messages of a caller that mean "try the next caller" (fixed values) ------------------
# (longer variants of these phrases exist but contain one of them)
QUOTA_PHRASES = ("quota exceeded", "quota limit", "rate limit", "quota has been exceeded")

# --- Rule extraction (fixed values) --------------------------------------------------------
COMPANY_SUFFIXES = ("Oyj", "Oy", "Ab", "Ltd", "Inc", "Group")
