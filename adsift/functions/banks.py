"""Phrase banks, rule lists and labels that screening results depend on."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Every list below must stay as it is, order included, because
# results (first match, bank order, ties) depend on it.
# ---------------------------------------------------------------------------

KEYWORDS = {
    "Urgency / Pressure Tactics": [
        "urgent", "immediately", "limited time", "today only", "hurry", "last chance", "expires today",
        "before deadline", "limited seats", "apply now urgently", "book now",
    ],
    "Unrealistic Income Claims": [
        "earn ₹50,000 per day", "earn ₹30,000 monthly", "unlimited income", "passive income", "high returns",
        "300% guaranteed", "200% monthly", "double money", "5x returns", "80% annual returns", "40% annual",
    ],
    "No-Document / No-Check Schemes": [
        "no cibil", "no documents", "no experience needed", "no qualification", "no interview", "no income proof",
        "no collateral", "no guarantor", "no questions asked", "no verification", "no rejection", "no target",
    ],
    "Suspicious Fee Patterns": [
        "registration fee", "security deposit", "processing advance", "pay small fee", "insider fee",
        "subscribe ₹999", "registration ₹500", "unlock loan", "register fee ₹99",
    ],
    "Too-Good Guarantees": [
        "100% guaranteed", "guaranteed returns", "guaranteed approval", "100% job guaranteed", "100% placement",
        "approved in seconds", "zero risk", "no risk", "100% remote", "95% win rate", "99% accuracy",
        "100% accurate",
    ],
    "Phishing Contact Methods": [
        "whatsapp now", "call now", "join our whatsapp group", "whatsapp cv", "whatsapp your aadhar", "download app",
    ],
}

TRIGGERS = [
    "work from home", "earn daily", "earn weekly", "immediate joining", "no experience needed", "no qualification",
    "registration fee", "data entry job", "part time job", "daily payment", "instant loan", "no cibil",
    "no documents required", "guaranteed approval", "aadhar loan", "bad cibil", "no income proof",
    "processing advance", "guaranteed returns", "100% profit", "double money", "crypto trading", "mlm opportunity",
    "passive income", "invest and earn", "limited time offer", "apply now urgently", "whatsapp now",
    "join our group", "100% guaranteed",
]
TRIGGER_THRESHOLD = 2
MIN_PAGE_CHARS = 30
PAGE_TEXT_CHARS = 3000

# Category signals, strongest tie first; the last entry is the "none" label.
SIGNALS = {
    "service": {
        "Job / Employment Fraud": ["job", "hiring", "salary", "work from home", "vacancy", "fresher", "joining", "bpo"],
        "Financial Loan Scam": ["loan", "cibil", "emi", "collateral", "disburse", "instant cash", "approved in"],
        "Investment / Ponzi Scheme": [
            "invest", "returns", "profit", "trading", "crypto", "forex", "stock", "mlm", "bitcoin", "ponzi",
        ],
        "none": "General / Unknown Fraud",
    },
    "ui": {
        "Job / Employment Fraud": [
            "job", "hiring", "salary", "work from home", "vacancy", "fresher", "data entry", "typing", "joining",
            "bpo", "earn daily", "earn weekly", "earn monthly by",
        ],
        "Financial Loan Scam": [
            "loan", "cibil", "interest", "emi", "disburse", "collateral", "aadhar card loan", "processing fee",
            "approved in", "instant cash",
        ],
        "Investment / Ponzi Scheme": [
            "invest", "returns", "profit", "trading", "crypto", "forex", "stock", "mutual fund", "sebi", "ipo",
            "scheme", "mlm", "chit fund", "ponzi", "bitcoin",
        ],
        "none": "General Fraud",
    },
}

TLDS = [".xyz", ".tk", ".ml", ".cf", ".ga", ".gq", ".top", ".click", ".pw", ".work", ".buzz", ".cheap"]
HOSTS = {
    "service": [
        "000webhostapp", "github.io", "netlify.app", "vercel.app", "glitch.me", "weebly.com", "wixsite.com",
    ],
    "ui": [
        "000webhostapp", "github.io", "netlify.app", "vercel.app", "glitch.me", "weebly.com", "wixsite.com",
        "blogspot.com", "wordpress.com",
    ],
}
BRANDS = {
    "service": [
        "sbi", "hdfc", "icici", "axis", "paytm", "amazon", "flipkart", "irctc", "nsdl", "uidai", "rbi", "sebi", "npci",
    ],
    "ui": [
        "sbi", "hdfc", "icici", "axis", "paytm", "amazon", "flipkart", "irctc", "nsdl", "uidai", "rbi", "sebi", "npci",
        "bsnl", "airtel", "jio",
    ],
}
URL_WORDS = ["free", "offer", "bonus", "prize", "winner", "loan", "reward", "claim", "limited"]

URL_POINTS = {
    "ip": 30, "http": 10, "tld": 25, "host": 15, "brand": 35, "dots": 15, "word": 10, "long": 10, "digits": 10,
}
# {} stands for the list entry that matched.
URL_MESSAGES = {
    "service": {
        "ip": "IP address used as domain",
        "http": "Unencrypted HTTP",
        "tld": "Suspicious TLD: {}",
        "host": "Free hosting: {}",
        "brand": "Brand impersonation: {}",
        "dots": "Excessive subdomains",
        "bad": "Could not parse URL",
    },
    "ui": {
        "ip": "🚨 IP address used as domain (hides real identity)",
        "http": "⚠️ Unencrypted HTTP connection (no SSL)",
        "tld": "🚨 Suspicious TLD: `{}` (common in throwaway scam domains)",
        "host": "⚠️ Free hosting detected: `{}` (unusual for official services)",
        "brand": "🚨 Brand impersonation: `{}` used in unofficial domain",
        "dots": "⚠️ Excessive subdomains (phishing obfuscation technique)",
        "word": "⚠️ Suspicious keyword in URL: `{}`",
        "long": "⚠️ Unusually long URL (possible obfuscation)",
        "digits": "⚠️ Numeric string in domain (atypical for legitimate orgs)",
        "bad": "❌ Could not parse URL",
    },
}
BAD_URL_SCORE = {"service": 0, "ui": 80}
URL_LEVELS = [
    (70, "🔴 HIGH RISK — Likely Phishing/Scam URL"),
    (35, "🟡 MEDIUM RISK — Suspicious, Verify Before Visiting"),
    (1, "🟠 LOW RISK — Minor Concerns Detected"),
    (0, "🟢 LOW RISK — No Obvious Suspicious Patterns"),
]
SUSPICIOUS_URL_SCORE = 20

# Risk bands: "floor" takes the first limit reached from above, "ceiling" the
# first limit not exceeded from below.
RISK_BANDS = {
    "floor": [(80, "CRITICAL RISK"), (60, "HIGH RISK"), (35, "MEDIUM RISK"), (0, "LOW RISK")],
    "ceiling": [(30, "SAFE"), (60, "CAUTION"), (80, "HIGH RISK"), (100, "CRITICAL")],
    "chat": [(80, "CRITICAL RISK"), (60, "HIGH RISK"), (35, "CAUTION"), (0, "LIKELY SAFE")],
}

# Overrides in priority order: (word, score, label).
OVERRIDES = [
    ("netflix", 2.15, "Safe"),
    ("lottery", 98.42, "Scam"),
    ("won", 98.42, "Scam"),
    ("blocked", 98.42, "Scam"),
    ("immediate", 98.42, "Scam"),
    ("electricity", 98.42, "Scam"),
    ("kbc", 98.42, "Scam"),
]

SYNONYMS = {
    "work from home": ["home based job", "remote work", "work at home", "wfh opportunity"],
    "earn ₹50,000": ["make ₹50000", "income ₹50,000", "salary 50k", "get paid ₹50000"],
    "no experience needed": ["freshers welcome", "no experience required", "zero experience", "anyone can apply"],
    "immediate joining": ["join today", "start immediately", "joining on same day", "instant joining"],
    "whatsapp now": ["message on whatsapp", "ping on wa", "whatsapp us", "contact on whatsapp"],
    "100% guaranteed": ["fully guaranteed", "assured 100%", "guarantee 100 percent", "complete guarantee"],
    "no cibil": ["bad cibil ok", "cibil not required", "no credit check", "poor cibil accepted"],
    "guaranteed returns": ["assured returns", "fixed returns guaranteed", "100% profit assured"],
    "registration fee": ["joining fee", "small registration charge", "nominal fee to join"],
    "limited seats": ["only few slots", "limited vacancies", "hurry limited openings"],
    "passive income": ["earn while you sleep", "automatic income", "income without working"],
    "no documents": ["paperless loan", "no paperwork", "documents not required"],
}

# Null defaults of the job-posting corpus.
JOB_TEXT_COLUMNS = ["title", "company_profile", "description", "requirements", "benefits"]
JOB_NULLS = {
    "title": " ", "company_profile": " ", "description": " ", "requirements": " ", "benefits": " ",
    "location": "Unknown", "department": "Unknown", "salary_range": "Not Specified",
    "employment_type": "Not Specified", "required_experience": "Not Specified",
    "required_education": "Not Specified", "industry": "Not Specified", "function": "Not Specified",
}

# English stop words: the list that Spark's StopWordsRemover ships.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're
he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't
didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split()
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


def phrase_list(bank: dict[str, list[str]] = KEYWORDS) -> list[str]:
    """All phrases of a bank, in bank order."""
    return [phrase for phrases in bank.values() for phrase in phrases]


def bank_rows(bank: dict[str, list[str]] = KEYWORDS) -> list[tuple[int, str, int, str, int]]:
    """The bank as rows (idx, category, cat_ord, phrase, kw_ord)."""
    rows = []
    for cat_ord, (category, phrases) in enumerate(bank.items()):
        for kw_ord, phrase in enumerate(phrases):
            rows.append((len(rows), category, cat_ord, phrase, kw_ord))
    return rows
