"""Word lists, patterns and catalogues, kept as data."""

# --- fixed values: results depend on these exact entries -----------------------------------

EXPORT_COLUMNS = [
    "Company Name", "Website", "LinkedIn", "Location", "Founded Year", "Industry",
    "Company Size", "Funding", "Product Description", "Products/Services", "Founders",
    "Founder LinkedIn Profiles", "CEO/Leadership", "Team", "Technology Stack", "Competitors",
    "Market Focus", "Social Media Links", "Latest News", "Investors", "Growth Metrics",
    "Contact", "Source URL",
]

FIELD_CATALOGUE = [
    "Company Name", "Founded Year", "Location", "Website", "Founders", "Funding Information",
    "Technology Stack", "Product Description", "Team Size", "Social Media", "Latest News",
    "Competitors", "Business Model", "Target Market",
]
BASIC_FIELDS = ["Company Name", "Founded Year", "Location", "Website"]

IMPORTANT_FIELDS = [
    "Company Name", "Founded Year", "Location", "Website", "Founders", "Funding Information",
    "Technology Stack", "Product Description",
]
RELEVANCE_WEIGHT = 0.6
QUALITY_WEIGHT = 0.4

GAP_FIELDS = [
    "Location", "Founded Year", "Industry", "Funding", "Company Description",
    "Products/Services",
]

# field -> kinds a model answer may have
FIELD_KINDS = {
    "Company Name": ["str"],
    "Website": ["str"],
    "LinkedIn": ["str"],
    "Location": ["str"],
    "Founded Year": ["str", "int"],
    "Industry": ["str"],
    "Company Size": ["str"],
    "Funding": ["str", "dict"],
    "Company Description": ["str"],
    "Products/Services": ["str", "list"],
    "Founders": ["str", "list"],
    "Founder LinkedIn Profiles": ["str", "list"],
    "CEO/Leadership": ["str", "dict", "list"],
    "Team": ["str", "dict", "list"],
    "Technology Stack": ["str", "list"],
    "Competitors": ["str", "list"],
    "Market Focus": ["str"],
    "Social Media Links": ["str", "dict"],
    "Latest News": ["str"],
    "Investors": ["str", "list"],
    "Growth Metrics": ["str", "dict"],
    "Contact": ["str", "dict"],
}

NAME_SUFFIXES = [
    "Inc", "LLC", "Ltd", "Limited", "Corp", "Corporation", "Co", "Company", "GmbH", "S.A.",
    "B.V.", "AG",
]
PLAIN_NAME_SUFFIX_PATTERNS = [
    r"\s+Inc\.?$", r"\s+LLC\.?$", r"\s+Ltd\.?$", r"\s+Limited$", r"\s+Corp\.?$",
    r"\s+Corporation$", r"\s+Co\.?$", r"\s+Company$", r"\s+GmbH$", r"\s+S\.?A\.?$",
    r"\s+B\.?V\.?$", r"\s+P\.?L\.?C\.?$",
]

LOCATION_PREFIXES = ["Located in", "Based in", "HQ in", "Headquarters in"]
FOUNDER_PREFIXES = ["Founded by", "Founders:", "Founders", "Founder:"]
FUNDING_PREFIXES = ["Funding:", "Raised", "Investment:"]
TECH_PREFIXES = ["Technology:", "Tech Stack:", "Technologies:"]
COMPETITOR_PREFIXES = ["Competitors:", "Competition:"]
WEBSITE_PATTERN = r"^https?://[a-zA-Z0-9][-a-zA-Z0-9.]*\.[a-zA-Z]{2,}(/.*)?$"
SIZE_WORDS = [("small", "1-10"), ("medium", "11-50"), ("large", "51-200"), ("enterprise", "201+")]
SOCIAL_PLATFORMS = [
    ("Twitter", ["twitter.com", "x.com"]),
    ("LinkedIn", ["linkedin.com"]),
    ("Facebook", ["facebook.com"]),
    ("Instagram", ["instagram.com"]),
    ("GitHub", ["github.com"]),
    ("YouTube", ["youtube.com"]),
]

URL_PATTERN = r"https?://\S+|www\.\S+"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
SPECIAL_PATTERN = r"""[^\w\s.,;:!?()\[\]{}"'-]"""

QUERY_STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "because", "as", "what", "which", "this", "that", "these", "those",
    "then", "just", "so", "than", "such", "both", "through", "about", "for", "is", "of", "while", "during", "to",
    "from", "in", "on", "by", "with", "at", "into",
]
TERM_STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by", "about", "as", "of", "from",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "shall", "should", "can", "could", "may", "might", "must", "that", "which", "who", "whom", "whose", "this",
    "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
]

DROPPED_TAGS = [
    "script", "style", "noscript", "iframe", "head", "meta", "link", "svg", "path", "button", "form", "input",
    "select", "option", "nav", "footer", "header",
]
DROPPED_CLASS_WORDS = [
    "cookie", "banner", "ad", "advertisement", "popup", "modal", "menu", "nav", "sidebar", "footer", "header",
    "comment", "social", "share", "related", "widget",
]
CONTENT_IDS = ["mw-content-text", "content", "main-content", "article-content", "post-content"]
CONTENT_TAGS = ["main", "article", "section", "div"]
CONTENT_CLASS_WORDS = ["content", "main", "article", "post"]
HIRING_WORDS = [
    "hiring", "remote", "onsite", "full-time", "fulltime", "position", "engineer", "developer", "www.", "http",
    "apply", "email", "contact",
]

TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid",
]
SITE_TYPES = [
    ("wordpress", ["wp-content", "wp-includes", "wp-admin"]),
    ("shopify", ["cdn.shopify.com", "shopify.com/s/"]),
    ("linkedin", ["linkedin.com/company/", "linkedin.com/in/"]),
    ("twitter", ["twitter.com", "t.co"]),
    ("facebook", ["facebook.com", "fb.com"]),
    ("news", ["article", "news", "blog", "post"]),
]
SKIP_SETS = {
    "discover": [
        "facebook.com", "twitter.com", "instagram.com", "linkedin.com/feed", "youtube.com",
        "pinterest.com", "reddit.com",
    ],
    "website": ["linkedin.com", "twitter.com", "facebook.com"],
    "official": [
        "linkedin.com", "twitter.com", "facebook.com", "instagram.com", "youtube.com",
        "crunchbase.com",
    ],
}
EXTRACTOR_HOSTS = [
    ("linkedin", "linkedin.com"),
    ("crunchbase", "crunchbase.com"),
    ("techcrunch", "techcrunch.com"),
    ("forum", "news.ycombinator.com"),
]

ORG_PATTERNS = [
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+(?:Inc|LLC|Ltd|Corp|Corporation|Company)",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+Technologies",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+Solutions",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+Systems",
    r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s+Software",
]
COMMON_ORGS = ["Facebook", "Google", "Microsoft", "Apple", "Amazon", "Twitter", "LinkedIn"]

# rule set -> (field, pattern) in the order they are tried
FACT_RULES = {
    "site": [
        ("Location", r"(?i)(?:located|based|headquarters) in ([^\.]+)"),
        ("Location", r"(?i)(?:HQ|Headquarters):\s*([^,\.]+(?:,\s*[A-Z]{2})?)"),
        ("Founded Year", r"(?i)(?:founded|established|started) in (\d{4})"),
        ("Industry", r"(?i)(?:industry|sector):\s*([^\.,]+)"),
        ("Industry", r"(?i)(?:operates|operating) in the ([^\.,]+) (?:industry|sector)"),
        ("Funding", r"(?i)(?:raised|secured|closed) (?:a|an)\s+([^\.,]+)\s+(?:funding|investment|round)"),
        ("Funding", r"(?i)(?:funding|investment) of\s+([^\.,]+)"),
    ],
    "page": [
        ("Location", r"(?i)(?:located|based|headquarters) in ([^\.]+)"),
        ("Location", r"(?i)(?:HQ|Headquarters):\s*([^,\.]+(?:,\s*[A-Z]{2})?)"),
        ("Founded Year", r"(?i)(?:founded|established|started) in (\d{4})"),
    ],
    "search": [
        ("Founded Year", r"[Ff]ounded in (\d{4})"),
        ("Founded Year", r"[Ee]stablished in (\d{4})"),
        ("Founded Year", r"[Ss]ince (\d{4})"),
        ("Location", r"[Hh]eadquartered in ([^\.]+)"),
        ("Location", r"[Bb]ased in ([^\.]+)"),
        ("Location", r"[Ll]ocated in ([^\.]+)"),
        ("Founders", r"[Ff]ounder[s]?:?\s+([^\.]+)"),
        ("Founders", r"[Ff]ounded by ([^\.]+)"),
        ("Funding Information", r"[Rr]aised ([^\.]+)"),
        ("Funding Information", r"[Ff]unding:?\s+([^\.]+)"),
        ("Funding Information", r"[Ii]nvestment:?\s+([^\.]+)"),
    ],
}

UI_WORDS = [
    "share", "click", "view", "read", "more", "next", "previous", "home", "about", "contact", "services",
    "products", "login", "sign", "register", "search", "menu", "navigation", "footer", "header", "copyright",
    "privacy", "terms", "policy", "cookies", "subscribe", "follow", "like", "comment", "download", "upload",
    "submit", "cancel", "continue", "back", "forward", "help", "support", "faq", "frequently", "asked", "questions",
    "blog", "news", "events", "careers", "jobs", "apply", "join", "team", "staff", "management", "board",
    "directors", "investors", "partners", "clients", "customers", "users", "members", "community",
]
UI_PHRASES = ["click here", "read more", "learn more", "sign up", "log in"]
NO_CONTEXT_NAMES = ["share", "view", "click", "read", "more", "next", "previous"]
KEYWORD_SKIP = ["and", "the", "for", "with"]
INDUSTRY_KEYWORDS = [
    "technology", "ai", "software", "biotech", "fintech", "energy", "healthcare", "climate", "sustainable", "data",
    "platform", "marketplace",
]

TRANSIENT_ERRORS = [
    "rate limit", "timeout", "connection", "network", "503", "500", "502", "504",
    "too many requests", "temporarily unavailable", "server error", "internal server error",
    "bad gateway", "gateway timeout", "service unavailable",
]
EMPTY_SPELLINGS = ["null", "Not available", ""]
NOT_AVAILABLE = "Not available"
UNKNOWN = "Unknown"

FACT_SOURCES = ["basic", "website_search", "linkedin", "crunchbase", "site", "general_search"]
MEMBERSHIP_STAGES = ["Potential", "LLM Extracted", "Validated", "Eliminated", "Final"]

# --- end of fixed values -------------------------------------------------------------------


def snake(title: str) -> str:
    """'CEO/Leadership' -> 'ceo_leadership'."""
    return title.lower().replace("/", "_").replace(" ", "_")
