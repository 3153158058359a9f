"""They have to equal the data model's own for results to agree."""

# Keyword rules of the router, first group with a hit wins.
ROUTE_KEYWORDS = [
    ("hypertension_first_line", ["فئات", "أولي", "first-line", "three drug", "classes", "ضغط الدم"]),
    ("statins_intensity", ["ستاتين", "statin", "شدة", "intensity", "كوليسترول", "دهون"]),
    ("pregnancy_contraindications", ["حمل", "pregnant", "pregnancy", "ace", "arb"]),
    ("task_shifting_who", ["غير الأطباء", "شروط", "non-physician", "who", "صيادلة"]),
]
DEFAULT_ROUTE = "default"
# Routes whose chunk lists make up the default list, in this order.
DEFAULT_ROUTE_PARTS = ["hypertension_first_line", "statins_intensity"]

# Retrieval and evidence.
TOP_K = 4
EVIDENCE_THRESHOLD = 0.65
CHUNK_THRESHOLD = 0.70
QUOTE_CHARS = 120
TITLE_CHARS = 38
DEFAULT_STRENGTH = "Strong"

# Domains.
ROLES = ["user", "assistant", "system"]
STRENGTHS = ["Strong", "Conditional", "Consider", "Not Recommended"]
ORGANIZATIONS = ["NICE", "WHO", "ESC", "ACC/AHA"]

# Column defaults and display fallbacks.
DEFAULT_TITLE = "محادثة سريرية جديدة"
DEFAULT_CLINICAL_ROLE = "Clinician"
DEFAULT_USER_LABEL = "Dr. User"
FALLBACK_TOKENS = 350
FALLBACK_RETRIEVAL_MS = 25
FALLBACK_GENERATION_MS = 320
FALLBACK_TOTAL_MS = 345

# Opening and default cause of the message that reports a failed request.
ERROR_OPENING = {
    "ar": "⚠️ حدث خطأ أثناء معالجة الطلب السريري:\n",
    "en": "⚠️ Error processing clinical query:\n",
}
ERROR_CAUSE = {
    "ar": "فشل الاتصال بمزود الذكاء الاصطناعي.",
    "en": "Failed to communicate with AI provider.",
}

# Score bands as (lowest percentage, label).
SCORE_BANDS = [(85, "high"), (70, "good"), (50, "fair")]
LOWEST_BAND = "low"

# Unicode ranges of Arabic script.
ARABIC_RANGES = [
    ("0600", "06FF"), ("0750", "077F"), ("08A0", "08FF"), ("FB50", "FDFF"), ("FE70", "FEFF"),
]

# Phrases that mark a refusal, and wording that is too certain.
REFUSAL_PHRASES = [
    "the available evidence does not provide enough information to answer this reliably",
    "this topic is outside the current scope of",
    "i couldn't find enough relevant information in the available medical guidelines to answer this reliably",
]
OVERCERTAIN_PHRASES = ["definitely", "certainly", "this proves", "you definitely have"]

# Recommendation wording that must not be swapped (evidence, answer).
STRENGTH_SHIFTS = [
    ("recommend", "consider"), ("consider", "recommend"), ("offer", "must"),
    ("may", "should"), ("should", "must"),
]

# Pregnancy terms and the drug classes not to be used with them.
PREGNANCY_TERMS = ["pregnan", "breastfeeding", "conception", "حمل"]
CONTRAINDICATED_CLASSES = [
    "ace inhibitor", "acei", "angiotensin receptor blocker", "arb", "statin",
]

# Headings of a structured answer.
DIRECT_HEADINGS = ["Direct Answer", "Explanation", "Evidence"]
RECOMMENDATION_HEADINGS = [
    "Recommendation", "Who It Applies To", "Evidence / Rationale",
    "Important Safety or Monitoring Considerations", "Sources",
]

# Source tiers, lowest number first; anything else is tier 3.
SOURCE_TIERS = [("NICE", 1), ("WHO", 1), ("Evidence review", 2)]
OTHER_TIER = 3
