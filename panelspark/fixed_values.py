"""Word lists, patterns and tables that results depend on. They are data, stated as they must be."""

# Sources whose headlines are never relevant.
SOURCE_BLOCKLIST = [
    "axs.com", "bleacherreport.com", "cbssports.com", "sbnation.com", "sportingnews.com", "foxsports.com", "espn.com",
    "fansided.com", "nbcsports.com", "hollywoodlife.com", "deadspin.com", "usmagazine.com", "radaronline.com",
    "pitchfork.com", "monstersandcritics.com",
]

# Patterns of consumer and deal content.
CONSUMER_PATTERN = (
    r"(\d+\s*%\s*off|\$\s*\d+\s*off|only\s+\$\s*\d+|save\s+\$\s*\d+|deals?\s+of\s+the\s+day|best\s+.{0,40}\s+deals?"
    r"|buying\s+guide|gift\s+(guide|ideas?|list)|black\s+friday\s+.{0,40}(deal|sale|offer|sav|discount|bargain)"
    r"|cyber\s+monday|prime\s+day|hands[\s\-]on\s+(review|preview|with)|unboxing|review:\s|vs\.?\s+.{0,30}:\s+which"
    r"|record\s+low\s+price|lowest\s+ever\s+price)"
)

# Banks that appear as raters of other firms (scoring filters / label filter).
ANALYST_FIRMS = [
    "Goldman Sachs", "Morgan Stanley", "JPMorgan Chase", "Bank of America", "Wells Fargo", "Citigroup", "UBS", "Barclays",
]
LABEL_ANALYST_FIRMS = [
    "Goldman Sachs", "Morgan Stanley", "JPMorgan Chase", "Bank of America", "Wells Fargo Securities", "Citigroup", "UBS",
    "Barclays", "Stifel", "Jefferies", "Raymond James", "Piper Sandler",
]

# Pattern of analyst rating actions.
ANALYST_ACTION_PATTERN = (
    r"\b(upgrades?|downgrades?|raises?\s+(?:its\s+)?(?:price\s+)?target|cuts?\s+(?:its\s+)?(?:price\s+)?target"
    r"|maintains?\s+(?:its\s+)?(?:buy|sell|neutral|hold|overweight|underweight)"
    r"|initiates?\s+(?:coverage|buy|sell|neutral|hold|overweight|underweight)"
    r"|reiterates?\s+(?:buy|sell|neutral|hold|overweight|underweight)"
    r"|boosts?\s+(?:price\s+)?target|lowers?\s+(?:price\s+)?target|lifts?\s+(?:price\s+)?target"
    r"|slashes?\s+(?:price\s+)?target|trims?\s+(?:price\s+)?target|bumps?\s+(?:price\s+)?target)\b"
)

# Patterns that show a firm's name means something else.
VISA_EXCLUSION = (
    r"\b(immigration|immigrant|work\s+visa|student\s+visa|travel\s+visa|tourist\s+visa|H-?1B|green\s+card|deportat"
    r"|border\s+patrol|customs|asylum|refugee|visa\s+application|visa\s+requirement|visa\s+renewal|visa\s+ban"
    r"|entry\s+visa|exit\s+visa|transit\s+visa|visa\s+free|visa\s+waiver)\b"
)
INTEL_EXCLUSION = (
    r"\b(military\s+intel(?:ligence)?|intelligence\s+agenc|CIA\s+intel|NSA\s+intel|spy|espionage|gather(?:ing)?\s+intel"
    r"|street\s+intel|competitive\s+intel(?:ligence)?|tower\s+22|drone\s+attack|airstrike|counterterrorism)\b"
)
TARGET_EXCLUSION = (
    r"\b(military\s+target|bombing\s+target|airstrike\s+target|missile\s+target|shooting\s+target|target\s+practice"
    r"|archery\s+target|sniper\s+target)\b"
)
HARD_EXCLUSIONS = {"Intel": INTEL_EXCLUSION, "Target": TARGET_EXCLUSION}
POST_EXCLUSIONS = {"Visa Inc.": VISA_EXCLUSION, "Intel": INTEL_EXCLUSION, "Target": TARGET_EXCLUSION}
LABEL_EXCLUSIONS = {"Visa Inc.": VISA_EXCLUSION, "Intel": INTEL_EXCLUSION}

# Patterns of the label filter.
CRIME_PATTERN = (
    r"\b(driver\s+(charged|arrested|accused|convicted|jailed|sentenced)|employee\s+(arrested|fired|charged|jailed|convicted)"
    r"|worker\s+(arrested|charged|jailed|convicted)|man\s+(killed|arrested|charged|shot|stabbed)"
    r"|woman\s+(killed|arrested|charged|shot|stabbed)|passenger\s+(killed|raped|assaulted|attacked)"
    r"|rider\s+(killed|raped|assaulted|attacked)|shooting\s+at\s+(a\s+)?(walmart|starbucks|mcdonald)"
    r"|murder(ed|er)?\s+(uber|lyft|airbnb)"
    r"|(uber|lyft|airbnb)\s+(driver|employee)\s+(rape|assault|murder|kill|attack|charged|arrested))\b"
)
LIFESTYLE_PATTERN = (
    r"\b(zodiac|horoscope|ideal\s+drink|valentine.s\s+(menu|drink|gift)|holiday\s+menu|seasonal\s+menu|new\s+flavor"
    r"|new\s+menu\s+item|refresher|latte\s+(recipe|secret|hack)|halloween\s+(costume|treat|decoration)"
    r"|christmas\s+(gift|decoration|deal)|gift\s+ideas?\s+for|what\s+to\s+buy|shopping\s+list)\b"
)
HEDGE_PATTERN = (
    r"\b(unclear|ambiguous|borderline|could\s+go\s+either\s+way|hard\s+to\s+say|difficult\s+to\s+determine|might\s+be"
    r"|possibly\s+relevant|tangentially|loosely\s+related|not\s+entirely\s+clear|somewhat\s+relevant)\b"
)

# Headline keywords per firm and the firms left out.
COMPANY_KEYWORDS = {
    "Microsoft": ["microsoft"], "Apple Inc.": ["apple"], "Amazon": ["amazon", "aws", "whole foods"],
    "Alphabet Inc. (Class A)": ["alphabet", "google", "youtube", "deepmind"],
    "Meta Platforms": ["meta platforms", "facebook", "instagram", "whatsapp", "oculus"], "Nvidia": ["nvidia"],
    "Tesla, Inc.": ["tesla"], "Berkshire Hathaway": ["berkshire", "warren buffett"],
    "Lilly (Eli)": ["eli lilly", "lilly"], "Broadcom": ["broadcom"], "Visa Inc.": ["visa"],
    "Mastercard": ["mastercard", "master card"], "ExxonMobil": ["exxonmobil", "exxon mobil"],
    "UnitedHealth Group": ["unitedhealth", "united health"],
    "Johnson & Johnson": ["johnson & johnson", "j&j", "janssen"], "Walmart": ["walmart", "wal-mart"],
    "Procter & Gamble": ["procter & gamble", "procter and gamble", "p&g"], "Home Depot (The)": ["home depot"],
    "Netflix": ["netflix"], "Salesforce": ["salesforce"], "Uber": ["uber"], "AT&T": ["at&t", "time warner", "directv"],
    "Intel": ["intel"], "General Motors": ["general motors"], "Airbnb": ["airbnb"], "FedEx": ["fedex"],
    "Starbucks": ["starbucks"], "Wells Fargo": ["wells fargo"], "Nike, Inc.": ["nike"],
    "Walt Disney Company (The)": ["disney"], "Pfizer": ["pfizer"], "Coca-Cola Company (The)": ["coca-cola", "coca cola"],
    "JPMorgan Chase": ["jpmorgan", "jp morgan", "jamie dimon"], "Ford Motor Company": ["ford motor", "ford "],
}
EXCLUDED_COMPANIES = ["Boeing", "Goldman Sachs", "Morgan Stanley"]

# Score adjustment rules in order of precedence. A rule fires when one of its ``phrases`` occurs in the
# lower-cased headline or one of its ``patterns`` matches, and every further condition holds. The score becomes
# max(floor, p - cut), or ``floor`` itself when ``cut`` is None.
_VISA_SIGNALS = [
    "visa liberalization", "visa waiver", "visa program", "visa backlog", "visa requirements", "visa processing",
    "student visa", "work visa", "h-1b", "tourist visa", "eu visa", "visa-free", "visa applicat", "visa subpoena",
    "visa rules", "visa delays", "visa reform", "biometric visa", "immigration visa", "travel visa", "ice",
    "deportation", "border",
]
ADJUSTMENT_RULES = [
    {"name": "G19:visa_contamination", "floor": 0.05, "cut": None, "company_contains": "visa", "phrases": _VISA_SIGNALS},
    {"name": "G12:analyst_preview", "floor": 0.05, "cut": 0.40, "phrases": [
        "what to expect from", "what to watch", "earnings preview", "what analysts are watching", "analyst estimates",
        "consensus estimates", "what wall street expects", "ahead of earnings", "before it reports", "preview:",
        "earnings: what", "q1 preview", "q2 preview", "q3 preview", "q4 preview"]},
    {"name": "G13:philanthropy", "floor": 0.05, "cut": 0.40,
     "patterns": [r"foundation.{0,60}\$\d",
                  r"\$[\d,.]+\s*(million|billion|M|B).{0,40}(fund|relief|grant|pledge|donat|scholar|commit|initiative)"],
     "phrases": ["pledges $", "commits $", "donates $", "charitable", "philanthrop"],
     "unless": ["fine", "penalt", "settl", "lawsuit", "regulat"]},
    {"name": "G15:brief_wire", "floor": 0.05, "cut": 0.35, "patterns": [r"^brief-"]},
    {"name": "G15:midlevel_appointment", "floor": 0.05, "cut": 0.35, "phrases": [
        "head of investor relations", "head of communications", "head of marketing", "head of sustainability",
        "head of digital", "head of government affairs", "head of supply chain", "director of investor",
        "director of communications", "vp of human", "vp of marketing", "vp of communications", "chief diversity officer",
        "chief of staff", "regional vice president", "regional director", "head of global partnerships",
        "head of corporate communications"],
     "also": ["names", "appoints", "promotes", "hires", "taps", "joins", "recruits"]},
    {"name": "G17:brand_comparator", "floor": 0.05, "cut": 0.40, "patterns": [
        r"\bthe\s+\w+\s+of\s+(china|india|europe|asia|africa|latin america|brazil|japan|korea|germany|france|uk|canada"
        r"|australia|mexico|indonesia|southeast asia)\b"]},
    {"name": "G17:brand_comparator", "floor": 0.05, "cut": 0.35,
     "phrases": ["'s answer to", "answer to the", "version of", "rival to"],
     "also_pattern": r"answer to (the\s+)?\w+|version of \w+"},
    {"name": "G20:disruption_catalyst", "floor": 0.05, "cut": 0.40, "patterns": [r"^competition with \w"]},
    {"name": "G20:disruption_catalyst", "floor": 0.05, "cut": 0.35, "patterns": [
        r"\b(taxi|hotel|cable|newspaper|travel agency|video rental)\b.{0,40}(struggle|brace|pivot|face|audit|lend)"]},
    {"name": "G11:speculative", "floor": 0.10, "cut": 0.25, "patterns": [
        r"\bconsiders (importing|exporting|entering|exiting|selling|buying|moving)\b"]},
    {"name": "G11:speculative", "floor": 0.10, "cut": 0.25, "patterns": [
        r"\b(mulls|weighing|exploring potential|may consider|studying options)\b"],
     "also": ["no deal", "no decision", "sources say", "people familiar", "early stage", "preliminary"]},
    {"name": "G16:local_economic", "floor": 0.05, "cut": 0.35, "patterns": [r"^([\w\s]+)\s+a big winner in"]},
    {"name": "G16:local_economic", "floor": 0.10, "cut": 0.25, "patterns": [
        r"^([\w\s]+)\s+(gains|gets|lands|wins).{0,30}(jobs|economic|boost|investment)"]},
    {"name": "G18:small_lawsuit", "floor": 0.05, "cut": 0.30, "patterns": [
        r"\$([1-9]|[1-3]\d|4[0-9])\s*(million|M)\b.{0,40}(lawsuit|suit|claim|allege)"]},
    {"name": "G18:small_lawsuit", "floor": 0.05, "cut": 0.30, "patterns": [
        r"\$[1-9]\d?m\s+lawsuit", r"lawsuit alleges.{0,30}\$[1-4]\d?\s*m"]},
]

# Thresholds of the sweep and buckets of the score histograms.
SWEEP_POINTS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.92, 0.95]
GRID_POINTS = [0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
POSITIVE_BUCKETS = [0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 1.01]
ALL_BUCKETS = [0.0, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 1.01]

# Published 5 % (and other) points of the KPSS statistic, and Johansen trace points at 95 %.
KPSS_POINTS = {"c": [0.347, 0.463, 0.574, 0.739], "ct": [0.119, 0.146, 0.176, 0.216]}
KPSS_P = [0.10, 0.05, 0.025, 0.01]
JOHANSEN_TRACE_95 = [15.4943, 3.8415]
