"""Word lists, patterns and limits. All of them are fixed values that results depend on."""

from __future__ import annotations

# Crawling (fixed values)
CONVENTIONAL_PATHS = (
    "/", "/contact", "/contact-us", "/contactus", "/about", "/about-us", "/aboutus", "/our-story", "/our-history", "/locations", "/location", "/address",
    "/find-us", "/findus", "/hours", "/hours-and-location", "/visit", "/visit-us", "/privacy", "/privacy-policy", "/menu", "/faqs", "/faq",
)
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")
CITATION_HOSTS = ("yelp.com", "facebook.com", "bbb.org", "yellowpages.com", "maps.google.", "google.com/maps", "foursquare.com", "tripadvisor.com")
LOCAL_HINTS = ("contact", "about", "hour", "location", "address", "visit", "find", "story", "history", "faq", "privacy", "menu")
SKIPPED_SCHEMES = ("mailto", "tel", "javascript", "data", "sms", "whatsapp")
SKIPPED_EXTENSIONS = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".avif", ".zip", ".mp4", ".mp3", ".css", ".js", ".ico", ".woff", ".woff2", ".ttf", ".eot",
    ".xml", ".json", ".csv", ".doc", ".docx", ".xls", ".xlsx",
)
MAX_PAGES, MAX_CITATIONS, MAX_BODY_BYTES, FETCH_TIMEOUT_S, FETCH_DELAY_S = 40, 8, 1_500_000, 15, 0.3
KEPT_HEADERS = ("content-type", "x-robots-tag", "location")
ROBOTS_BODY_CHARS, LISTED_SITEMAP_URLS = 4000, 50

# Audit (fixed values)
LOCAL_TYPES = (
    "localbusiness", "restaurant", "store", "foodestablishment", "dentist", "physician", "legalservice", "attorney", "realestatesagent", "electrician",
    "plumber", "hvacbusiness", "autorepair", "hotel", "motel", "lodgingbusiness", "medicalclinic", "professionalservice",
)
ANSWER_TYPES = ("faqpage", "qapage", "howto", "article", "newsarticle", "blogposting")
GENERIC_ANCHORS = ("click here", "here", "read more", "more", "link")
ERROR_TITLES = ("404", "not found")
TITLE_CHARS, DESCRIPTION_CHARS, THIN_WORDS, LONG_CHAIN = (15, 65), (50, 165), 150, 3
EVIDENCE_KEY_CHARS = 180
ROBOTS_BLOCK_ERROR = "disallowed by robots.txt"

# Names, addresses, phones (fixed values)
FIELDS = ("business_name", "phone", "street_address", "city", "region", "postal_code", "full_address")
NAP_TYPES = ("localbusiness", "organization", "restaurant", "store", "foodestablishment", "place", "postaladdress", "dentist", "attorney", "hotel", "motel")
MICRODATA_TYPES = ("organization", "localbusiness", "restaurant", "foodestablishment", "store")
LEGAL_SUFFIXES = ("incorporated", "inc", "llc", "ltd", "limited", "co", "corp", "company", "plc", "pllc")
ADDRESS_WORDS = {
    "street": "st", "st": "st", "avenue": "ave", "ave": "ave", "road": "rd", "rd": "rd", "boulevard": "blvd", "blvd": "blvd", "drive": "dr", "dr": "dr",
    "lane": "ln", "ln": "ln", "court": "ct", "ct": "ct", "place": "pl", "pl": "pl", "highway": "hwy", "hwy": "hwy", "parkway": "pkwy", "pkwy": "pkwy",
    "suite": "ste", "ste": "ste", "north": "n", "south": "s", "east": "e", "west": "w",
}
PHONE = r"(?:(?:\+|00)\s?1[\s.\-]?)?(?:\(?\d{3}\)?[\s.\-]?)\d{3}[\s.\-]?\d{4}"
STREET = (
    r"\b\d{1,6}\s+[A-Za-z0-9.'\-]+(?:\s+[A-Za-z0-9.'\-]+){0,5}\s+"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct|Place|Pl|Highway|Hwy|Parkway|Pkwy|Circle|Cir)\b"
    r"(?:[,\s]+(?:Suite|Ste|Unit|#)\s?[A-Za-z0-9\-]+)?"
)
CITY_STATE_ZIP = r"\b([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+){0,2}),\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)\b"
CITY_ZIP = r"\b([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+){0,3}),\s+(\d{5}(?:-\d{4})?)\b"
SCOPE_CHARS, NAME_CHARS, PHONE_DIGITS = 2500, (2, 90), 10
DOMINANT_PAGES, DOMINANT_SHARE = 2, 0.6
PROPOSAL_KEYS = {
    "name": "business_name", "business_name": "business_name", "phone": "phone", "telephone": "phone", "address": "full_address", "full_address": "full_address",
    "street_address": "street_address", "city": "city", "region": "region", "state": "region", "postal_code": "postal_code", "zip": "postal_code",
}
PROPOSAL_PAGE_HINTS, PROPOSAL_PAGES, PROPOSAL_CHARS = ("contact", "about", "location", "find", "address", "hour"), 4, 3500

# Retrieval (fixed values)
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "by", "at", "as", "from", "that", "this", "it",
    "its", "your", "our", "you", "we", "do", "does", "what", "when", "where", "who", "how", "why", "which", "can", "could", "should", "would", "about",
    "please", "tell", "me",
)
HOUR_TERMS = ("hour", "hours", "open", "opening", "opened", "close", "closed", "closing", "schedule")
PLACE_TERMS = ("address", "located", "location", "where", "street", "directions")
TIME = r"\b(?:[01]?\d|2[0-3])(?::[0-5]\d)?\s*(?:[ap]\.?m\.?)\b|\b24\s*(?:hours|hrs)\b"
NUMBER_THEN_WORD = r"\b\d{1,6}\s+[A-Za-z]"
CHROME_PHRASES = r"skip to (?:content|main)|cookies are disabled|login / register"
CHUNK_CHARS, BLOCK_CHARS, OUTLINE_CHARS = 420, 50, 200
BM25_K1, BM25_B, HOUR_BOOST, PLACE_BOOST, RRF_CONSTANT = 1.5, 0.75, 4.0, 2.5, 60
LEXICAL_K, VECTOR_K, FUSED_K, SEARCH_K, LISTED_URLS = 12, 8, 8, 4, 40
ABSTAIN_NO_TERMS, ABSTAIN_LEXICAL, ABSTAIN_WEAK, NULL_PICK_COVERAGE = 1.5, 2.0, 0.35, 0.45
