"""Word lists and patterns used by the text operators."""

# Stop words of the retrieval query tokeniser.
QUERY_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in",
    "is", "of", "on", "or", "the", "to", "with",
]

# Stop words of the claim-word tokeniser.
CLAIM_STOP_WORDS = [
    "about", "after", "also", "and", "are", "because", "been", "being",
    "between", "company", "for", "from", "has", "have", "its", "more", "not",
    "that", "the", "their", "this", "was", "were", "with",
]

# Words that raise a news item's materiality score.
NEWS_KEYWORDS = [
    "acquisition", "acquires", "acquire", "merger", "buys",
    "order", "contract", "capex", "expansion", "invest",
    "results", "profit", "revenue", "earnings", "loss",
    "rating", "downgrade", "upgrade", "outlook",
    "regulator", "regulatory", "penalty", "fine", "sebi",
    "board", "management", "resignation", "appoint",
    "fundraising", "bonds", "loan", "refinanc",
    "capacity", "plant", "launch", "listing", "ipo",
    "buyback", "dividend", "split", "bonus",
    "chairman", "ceo", "cfo",
]

# Weights of the news materiality score.
NEWS_BASE_SCORE = 0.1
NEWS_KEYWORD_SCORE = 0.08
NEWS_RUPEE_SCORE = 0.1
NEWS_SCALE_SCORE = 0.06
NEWS_MIN_SCORE = 0.18

# Announcement categories that are always material.
MATERIAL_CATEGORIES = [
    "Result", "Financial Results", "Quarterly Results",
    "Investor Presentation", "Corporate Action", "Board Meeting",
    "Acquisition", "Amalgamation / Merger", "Change in Directors / KMP",
    "Credit Rating", "Loss/Duplicate", "New Certificate",
    "Regulation 30 (LODR)", "Postal Ballot", "General Updates",
    "Fund Raising",
]

# Subject words that make an announcement material.
MATERIAL_SUBJECT_WORDS = [
    "acquisition", "rating", "results", "investor presentation", "earnings",
    "conference call", "earnings call", "transcript", "audio", "director",
    "resignation", "appointment", "dividend", "buyback", "regulation 30",
    "regulation 46", "capex", "expansion", "scheme",
]

# Announcement type by subject phrase, first match wins.
ANNOUNCEMENT_TYPES = [
    ("concall", ["earnings call transcript", "concall transcript",
                 "conference call transcript",
                 "investor conference call transcript"]),
    ("investor_presentation", ["investor presentation",
                               "earnings presentation"]),
    ("credit_rating", ["credit rating"]),
]

# News category by title word, first match wins.
NEWS_CATEGORIES = [
    ("M&A", ["acquisition", "merger"]),
    ("Credit", ["rating"]),
    ("Results", ["result", "earnings"]),
    ("Business", ["order", "contract"]),
    ("Regulatory", ["regulator", "sebi"]),
    ("Capital Returns", ["dividend", "buyback"]),
    ("Management", ["appoint", "resign"]),
]
NEWS_DEFAULT_CATEGORY = "General"

# Phrases that turn a stated fact into an interpretation.
INTERPRETIVE_PHRASES = [
    "indicat", "suggest", "demonstrat", "robust", "strong", "key driver",
    "essential", "warrant", "influenc", "may ", "could ", "pose ",
    "on track", "expected to", "will enhance",
]

# Words around a financial figure.
NON_FINANCIAL_WORDS = [
    "promoter", "shareholding", "shares held", "subscriber", "employee",
    "store count", "location", "locations",
]
FINANCIAL_OVERRIDE_WORDS = [
    "paid-up capital", "revenue", "profit", "ebitda", "cash", "debt",
    "borrowings", "capex",
]
FINANCIAL_WORDS = [
    "revenue", "profit", "pat", "ebitda", "eps", "cash", "debt",
    "borrowings", "capex", "margin", "receivables", "inventory", "payables",
    "crore", "million", "billion",
]

# Subjects whose figures must stand near their name.
SUBJECT_PATTERNS = [
    ["oil to chemicals", "o2c"],
    ["reliance retail", "retail segment"],
    ["digital services", "jio platforms", "reliance jio"],
    ["oil and gas"],
    ["new energy"],
]
SUBJECT_DISTANCE = 260

# Words of a guidance statement.
GUIDANCE_WORDS = [
    "guidance", "target", "expect", "outlook", "plan", "project",
    "forecast", "aim", "intend",
]

# Allowed labels and their defaults.
ALLOWED_BASES = ["CONSOLIDATED", "STANDALONE", "NOT_CLEAR", "NOT_APPLICABLE"]
ALLOWED_CLASSES = ["FACT", "INFERENCE", "UNCERTAIN"]
ALLOWED_CONFIDENCE = ["HIGH", "MEDIUM", "LOW"]
