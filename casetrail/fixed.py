"""Vocabularies, ordered rules and patterns the results depend on.

Everything here is data.  Patterns are Java regular expressions; ``(?i)`` marks
the ones that ignore case.
"""

CLASSIFIER_VERSION = "deterministic-v1"
EXTRACTOR_VERSION = "deterministic-interview-v1"
CALENDAR_VERSION = "calendar-interview-v1"
SNAPSHOT_VERSION = "attributed-analytics-v1"

# --- message classification: ordered rules (type, confidence, phrases) ------
# Fixed values.  Order is precedence: the first rule with a hit decides.
CLASSIFICATION_RULES = (
    ("OFFER_ACCEPTED", 0.98, ("offer acceptance confirmed", "accepted your offer")),
    ("OFFER_DECLINED", 0.98, ("declined the offer", "offer decline confirmed")),
    ("OFFER_EXPIRED", 0.98, ("offer has expired", "offer expired")),
    ("OFFER_UPDATE", 0.98, ("updated offer", "revised offer", "offer update")),
    ("INTERVIEW_CANCELLATION", 0.98, ("interview has been cancelled", "cancelled interview")),
    ("INTERVIEW_RESCHEDULE", 0.98, ("reschedule your interview", "interview rescheduled")),
    ("INTERVIEW_CONFIRMATION", 0.98, ("interview is confirmed", "interview confirmation")),
    ("INTERVIEW_INVITATION", 0.98, ("schedule your interview", "interview invitation")),
    ("ASSESSMENT_REMINDER", 0.98, ("assessment reminder", "reminder to complete the assessment")),
    ("ASSESSMENT_INVITATION", 0.98, ("complete an assessment", "assessment invitation")),
    ("REJECTION", 0.98, ("not moving forward", "decided not to proceed", "other candidates")),
    ("POSITION_CLOSED", 0.98, ("position has been closed", "role is no longer available")),
    ("WITHDRAWAL", 0.98,
     ("withdraw my application", "application withdrawal confirmed", "application withdrawn")),
    ("APPLICATION_CONFIRMATION", 0.98,
     ("thank you for applying", "application received", "successfully applied")),
    ("OFFER", 0.98, ("pleased to offer you", "employment offer", "offer letter")),
    ("RECRUITER_FOLLOW_UP", 0.94, ("following up", "checking in regarding")),
    ("RECRUITER_REPLY", 0.94, ("thanks for getting back", "thank you for your reply")),
    ("RECRUITER_OUTREACH", 0.94, ("reaching out about", "your background caught my attention")),
    ("REFERRAL", 0.96, ("referred you", "employee referral", "referral introduction")),
    ("NETWORKING", 0.92, ("connect professionally", "networking conversation", "coffee chat")),
    ("GHOSTING", 0.9, ("no response after multiple follow-ups", "have not heard back after")),
    ("GENERAL_COMPANY_COMMUNICATION", 0.86,
     ("company update", "careers newsletter", "talent community")),
)
UNKNOWN_TYPE = "UNKNOWN"
NO_RULE_REASON = "no deterministic rule matched"
MESSAGE_TYPES = tuple(r[0] for r in CLASSIFICATION_RULES) + (UNKNOWN_TYPE,)

# --- groups of message types (fixed values) ---------------------------------
INTERVIEW_TYPES = (
    "INTERVIEW_INVITATION", "INTERVIEW_CONFIRMATION", "INTERVIEW_RESCHEDULE",
    "INTERVIEW_CANCELLATION", "ASSESSMENT_INVITATION", "ASSESSMENT_REMINDER",
)
OFFER_TYPES = ("OFFER", "OFFER_UPDATE", "OFFER_EXPIRED", "OFFER_ACCEPTED", "OFFER_DECLINED")
REJECTION_TYPES = ("REJECTION", "POSITION_CLOSED")
RECRUITER_TYPES = ("RECRUITER_OUTREACH", "RECRUITER_REPLY", "RECRUITER_FOLLOW_UP")
# narrow: every type feeds one group
OUTCOME_GROUPS = {
    "recruiter_replies": RECRUITER_TYPES,
    "interviews": INTERVIEW_TYPES,
    "offers": OFFER_TYPES,
    "rejections": REJECTION_TYPES,
}
# broad: interview and offer evidence also counts as a reply
OUTCOME_METRICS = {
    "recruiter_replies": RECRUITER_TYPES + INTERVIEW_TYPES + OFFER_TYPES,
    "interviews": INTERVIEW_TYPES,
    "offers": OFFER_TYPES,
    "rejections": REJECTION_TYPES,
}
METRICS = ("applications", "recruiter_replies", "interviews", "offers", "rejections")
REVIEWABLE_TYPES = RECRUITER_TYPES + INTERVIEW_TYPES + OFFER_TYPES + REJECTION_TYPES
CONFIRMATION_TYPE = "APPLICATION_CONFIRMATION"
NOT_AN_APPLICATION = ("new", "saved", "withdrawn")

# --- interviews (fixed values) ----------------------------------------------
EVENT_TYPES = {
    "INTERVIEW_INVITATION": "invitation",
    "INTERVIEW_CONFIRMATION": "confirmation",
    "INTERVIEW_RESCHEDULE": "reschedule",
    "INTERVIEW_CANCELLATION": "cancellation",
    "ASSESSMENT_INVITATION": "assessment_invitation",
    "ASSESSMENT_REMINDER": "assessment_reminder",
}
EVENT_STATUS = {
    "confirmation": "confirmed", "reschedule": "rescheduled", "cancellation": "cancelled",
}
INTERVIEW_PHRASES = (
    ("recruiter_screen", ("recruiter screen", "phone screen")),
    ("technical", ("technical interview", "coding interview")),
    ("panel", ("panel interview", "interview panel")),
    ("onsite", ("onsite interview", "on-site interview")),
    ("hiring_manager", ("hiring manager interview", "manager interview")),
    ("final", ("final interview", "final round interview")),
)
ZONE_HOURS = {
    "PST": -8, "PDT": -7, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5,
    "MST": -7, "MDT": -6, "UTC": 0,
}
MEETING_DOMAINS = (
    "zoom.", "teams.microsoft.", "meet.google.", "webex.", "hackerrank.", "codesignal.",
)
AMBIGUITY_UNPARSED = "date or time could not be parsed; schedule omitted"
AMBIGUITY_NO_ZONE = "timezone missing or ambiguous; UTC was not fabricated"
AMBIGUITY_ZONES = "multiple timezone abbreviations found"
AMBIGUITY_UNLINKED = "no deterministic job linkage"

# --- postings and sites (fixed values) --------------------------------------
ATS_DOMAINS = {
    "greenhouse.io": "Greenhouse",
    "lever.co": "Lever",
    "myworkdayjobs.com": "Workday",
    "ashbyhq.com": "Ashby",
    "smartrecruiters.com": "SmartRecruiters",
    "icims.com": "iCIMS",
    "jobvite.com": "Jobvite",
    "linkedin.com": "LinkedIn",
}
BOARD_LABELS = (
    "linkedin", "greenhouse", "lever", "workday", "indeed", "smartrecruiters", "ashbyhq",
)
CONFIRMATION_PATTERNS = (
    r"thank you for applying",
    r"application (?:has been )?received",
    r"we received your application",
    r"application confirmation",
    r"thanks for your interest",
    r"successfully applied",
    r"your application to",
    r"submitted your application",
)
TITLE_PATTERNS = (
    r"(?i)(?:position|role|job)\s*[:\-]\s*([^\n]{3,180})",
    r"(?i)(?:for|to)\s+(?:the\s+)?(?:position|role|job)(?:\s+of)?\s+([^\n]{3,180})",
    r"(?i)application\s+(?:for|to)\s+([^\n]{3,180})",
)
TITLE_PREFIX = r"(?i)^(?:the\s+)?(?:position|role|job)(?:\s+of)?\s+"
TITLE_BOUNDARY = (
    r"(?i)(?:\.|\s+(?:and|at|with|where|while|if|we|our|your|you)\b|\s+-\s+(?:we|our)\b)"
)
TITLE_STOP = ("application", "application confirmation", "your application")
SUBJECT_COMPANY_PATTERNS = (
    r"(?:application|interest)\s+(?:to|at|with)\s+([A-Z][A-Za-z0-9& .'-]{2,80})",
    r"([A-Z][A-Za-z0-9& .'-]{2,80})\s+(?:application|careers)",
)
JOB_VIEW_PATTERN = r"(?i)linkedin\.com/jobs/view/(\d+)"
JOB_TOKEN_PATTERN = r"(?i)(?:job|requisition|req)\s*(?:id|#)?\s*[:#-]?\s*([A-Z0-9_-]{4,30})"
REQUISITION_PATTERNS = (
    r"(?i)requisition\s*(?:id|#)?\s*[:#-]?\s*([A-Z0-9_-]{4,30})",
    r"(?i)req\s*(?:id|#)?\s*[:#-]?\s*([A-Z0-9_-]{4,30})",
    r"(?i)job\s*id\s*[:#-]?\s*([A-Z0-9_-]{4,30})",
)
URL_PATTERN = r'(https?://[^\s<>"]+)'
APPLICANT_PATTERNS = (   # (pattern, counts as "over")
    (r"(?i)\bover\s+(\d{1,3}(?:,\d{3})*)\s+people\s+clicked\s+apply\b", True),
    (r"(?i)\bover\s+(\d{1,3}(?:,\d{3})*)\s+applicants?\b", True),
    (r"(?i)\b(\d{1,3}(?:,\d{3})*)\s+people\s+clicked\s+apply\b", False),
    (r"(?i)\b(\d{1,3}(?:,\d{3})*)\+?\s+applicants?\b", False),
)
SALARY_PATTERN = (
    r"(?i)(\$[\d,.]+(?:K)?(?:/(?:yr|year|hr|hour))?\s*-\s*\$[\d,.]+(?:K)?(?:/(?:yr|year|hr|hour))?)"
)
POSTED_PATTERN = (
    r"(?i)\b((?:reposted\s+)?(?:\d+\s+(?:minute|hour|day|week|month)s?\s+ago|today|yesterday))\b"
)
PLACE_PATTERN = (
    r"(?i)\b((?:United States|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2})"
    r"(?:\s*\((?:Remote|Hybrid|On-site)\))?)"
)
WORK_MODES = (
    ("Remote", r"(?i)\bRemote\b"), ("Hybrid", r"(?i)\bHybrid\b"), ("On-site", r"(?i)\bOn-site\b"),
)

# --- contacts (fixed values) --------------------------------------------------
GENERIC_MAIL_DOMAINS = ("gmail.com", "hotmail.com", "outlook.com", "yahoo.com", "icloud.com")
GENERIC_LOCAL_PARTS = ("careers", "jobs", "noreply", "no-reply", "notifications")
CONTACT_COMPANY_PATTERN = (
    r"\b(?:at|with|from)\s+([A-Z][A-Za-z0-9&.'-]*(?:\s+[A-Z][A-Za-z0-9&.'-]*){0,4})(?=[,.;\n]|$)"
)
PROFILE_PATTERN = r"(?i)(https?://(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+/?)"
PHONE_PATTERN = r"(?<!\d)((?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})(?!\d)"
CONTACT_TITLE_PATTERN = (
    r"(?im)^\s*((?:senior |lead |principal )?(?:technical )?"
    r"(?:recruiter|sourcer|talent partner|talent acquisition|recruiting coordinator))\s*$"
)
RECRUITING_WORDS_PATTERN = (
    r"(?i)\b(?:recruiter|sourcer|talent partner|talent acquisition|recruiting coordinator)\b"
)
LOCATION_PATTERN = r"(?i)\b(?:location|address)\s*:\s*([^.;\n\r]+)"
EVENT_ID_PATTERN = (
    r"(?i)\b(?:calendar\s+uid|event\s+id|meeting\s+id)\s*:\s*([A-Za-z0-9_.@-]+)"
)
INTERVIEW_JOB_PATTERN = (
    r"(?i)\b(?:job|requisition|req)\s*(?:id|#)?\s*[:#-]?\s*([A-Z0-9_-]{4,30})"
)

# --- dates and times (fixed values) --------------------------------------------
ISO_DATE_PATTERN = r"\b(20\d{2}-\d{2}-\d{2})\b"
MONTH_DATE_PATTERN = (
    r"(?i)\b((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    r"Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
    r"\s+\d{1,2},\s+20\d{2})\b"
)
TIME_PATTERN = r"(?i)\b(\d{1,2}(?::\d{2})?\s*(?:AM|PM))\b"
ZONE_PATTERN = r"(?i)\b(PST|PDT|EST|EDT|CST|CDT|MST|MDT|UTC)\b"
DURATION_PATTERN = r"(?i)\b(\d{1,3})\s*(?:minutes?|mins?)\b"

# --- company and title words (fixed values) ---------------------------------------
MATCH_COMPANY_WORDS = r"(?i)\b(inc\.?|llc|corp\.?|corporation|company|ltd\.?)\b"
CONTACT_COMPANY_SUFFIX = (
    r"(?i)\b(?:incorporated|inc|llc|ltd|limited|corp|corporation|co|company)\b\.?"
)
ENTITY_SUFFIXES = ("corp", "corporation", "inc", "incorporated", "llc", "ltd", "limited")
SENIORITY_WORDS = r"(?i)\b(sr\.?|senior|lead|principal|staff|manager|director|head of)\b"
STOP_TERMS = (
    "and", "at", "for", "from", "in", "job", "of", "or", "role", "the", "to", "with",
)
GENERIC_COMPANY_PATTERN = (
    r"(?i)\b(interview|manager|marketing|engineer|engineering|product|recruiter|enterprise|"
    r"position|role|your|unknown|workday|myworkday|hiring|digital|landing|candidate|candidates|"
    r"recruiting|recruitment|careers?|application|status|confirmed|confidential|talent|director|"
    r"message|thanks|forward|greenhouse)\b"
)
MEETING_PLATFORMS = ("google", "google meet", "teams", "zoom", "phone", "video")
GENERIC_COMPANY_NAMES = (
    "app", "ats", "com", "email", "gmail", "join", "move", "msg", "update", "zoom video",
)

# --- roles and stages (fixed values; order is precedence) ---------------------------
SPECIFIC_ROLE_RULES = (
    ("Solutions Consulting", r"(?i)\b(?:solutions?|technical)\s+consultant\b"),
    ("Sales Engineering",
     r"(?i)\b(?:sales|pre[ -]?sales|field|enterprise|technical|systems?|solutions?)\s+engineer\b"),
    ("Delivery Management", r"(?i)\b(?:technical\s+)?delivery\s+manager\b"),
    ("Operations Management",
     r"(?i)\b(?:operations?|ops)\s+(?:program\s+)?(?:manager|analyst)\b"),
)
ROLE_RULES = (
    ("Fleet / Field Operations",
     r"(?i)\b(?:vehicle operator|fleet operations?|field operations?|fleet management)\b"),
    ("Product Management", r"(?i)\b(product manager|product management|product growth)\b"),
    ("TPM / Program", r"(?i)\b(technical program|technical project|program manager)\b"),
    ("Lifecycle / CRM", r"(?i)\b(lifecycle|crm|retention|email marketing)\b"),
    ("GTM / Sales Engineering",
     r"(?i)\b(sales engineer|solutions? architect|technical solutions?|gtm)\b"),
    ("Performance Marketing", r"(?i)\b(performance marketing|paid media|sem)\b"),
    ("Demand Generation", r"(?i)\b(demand gen|demand generation|abm)\b"),
    ("Growth Marketing", r"(?i)\b(growth marketing|growth manager)\b"),
    ("Delivery / Operations", r"(?i)\b(delivery|operations|driver)\b"),
    ("Product Marketing", r"(?i)\bproduct marketing\b"),
)
STAGE_RULES = (
    ("final", r"(?i)\b(final|finalist|executive interview)\b"),
    ("hm_team", r"(?i)\b(hiring manager|hm interview|team interview|panel)\b"),
    ("recruiter",
     r"(?i)\b(recruiter|phone screen|screening|talent acquisition|intro call)\b"),
)
STAGES = ("final", "hm_team", "recruiter", "unknown")

# --- calendar review (fixed values) ---------------------------------------------------
CALENDAR_INTERVIEW = (
    r"(?i)\b(interview|screen|screening call|recruiter call|talent acquisition|"
    r"intro call|introductory interview|onsite prep)\b"
)
CALENDAR_EXCLUDE = r"(?i)\b(edd interview|career advising|job search|job termination)\b"
CALENDAR_REVIEW = (
    r"(?i)\b(phone call|talent team|hiring|recruiter|call for .+ job|chat w/)\b"
)
SUMMARY_COMPANY_PATTERNS = (
    r"(?i)interview with ([^|–—:-]+)",
    r"(?i)interview (?:at|with recruiter at) ([^|–—:-]+)",
    r"(?i)phone screen at ([^|–—:-]+)",
)
SUMMARY_PREFIX_PATTERN = (
    r"(?i)^(.{2,50}?)\s+(?:virtual\s+|video\s+|phone\s+|teams\s+|google meet\s+)?"
    r"(?:interview|recruiter call|phone screen)"
)
# context in which a dictionary company counts; NAME is replaced by the quoted company
TEXT_CONTEXT_BEFORE = r"(?:\b(?:at|with|from|for|join)\s+)NAME(?!\w)"
TEXT_CONTEXT_AFTER = r"(?<!\w)NAME.{0,30}\b(?:role|position|team|interview|application)\b"
SUMMARY_CONTEXT_AFTER = r"(?<!\w)NAME(?!\w).{0,35}\b(interview|screen|recruiter call)\b"
SUMMARY_CONTEXT_BEFORE = (
    r"\b(interview|screen|recruiter call)\b.{0,35}\b(with|at|from|and)\s+NAME(?!\w)"
)

# --- reports (fixed values) --------------------------------------------------------------
JOB_CSV_FIELDS = (
    "score", "applicant_count", "applicant_count_is_over", "title", "company", "location",
    "salary_text", "email_account", "role_family", "resume_family", "applied_at",
    "ats_platform", "requisition_id", "import_confidence", "status", "url",
)
DUPLICATE_FIELDS = (
    "id", "email_account", "source", "company", "title", "applied_at", "status",
    "ats_platform", "requisition_id", "import_confidence",
)
DUPLICATE_MATERIAL = (
    "company", "title", "applied_at", "status", "ats_platform", "requisition_id",
)
DUPLICATE_EXACT = "likely exact duplicate"
DUPLICATE_PROBABLE = "probable duplicate needing review"
DUPLICATE_CONFLICT = "conflicting record requiring manual review"
PROVIDERS = ("gmail", "hotmail", "yahoo")
CONTENT_COLUMNS = (
    "app_password", "authorization", "body", "message_id", "password", "raw_mime",
    "recipients", "refresh_token", "sender", "subject", "token", "username",
)
LEDGER_KNOWN_STATUSES = ("applied", "recruiter", "interview", "offer", "rejected")
BODY_LIKE_PATTERN = r"(?i)(applicable law|personal data|privacy|unsubscribe)"
