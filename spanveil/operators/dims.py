"""Entity types, patterns and phrase lists. Larger dictionaries (health, child, names) are the caller's tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

# fixed values: entity types with their name, radix and least length for encryption (0: tokens), label and token prefix
TYPES = [
    ("credit_card", 10, 15, "[REDACTED]", "RED"),
    ("ssn", 10, 9, "[REDACTED]", "RED"),
    ("phone", 10, 10, "[REDACTED]", "RED"),
    ("email", 36, 4, "[REDACTED]", "RED"),
    ("api_key", 62, 6, "[REDACTED]", "RED"),
    ("ipv4_address", 10, 4, "[IPv4]", "IP4"),
    ("ipv6_address", 16, 2, "[IPv6]", "IP6"),
    ("gps_coordinate", 10, 6, "[GPS]", "GPS"),
    ("mac_address", 16, 6, "[MAC]", "MAC"),
    ("health_keyword", 0, 0, "[HEALTH]", "HLT"),
    ("child_keyword", 0, 0, "[CHILD]", "CHL"),
    ("person", 0, 0, "[PERSON]", "PER"),
    ("location", 0, 0, "[LOCATION]", "LOC"),
    ("organization", 0, 0, "[ORG]", "ORG"),
    ("iban", 36, 6, "[IBAN]", "IBN"),
]


@dataclass(frozen=True)
class Pattern:
    key: str
    lang: str | None
    type: str
    regex: str
    validator: str | None = None
    guard: bool = False  # neighbours must not be digits

    @property
    def needs(self) -> tuple[str, ...]:
        """Texts of which every match holds one; none if there are no such. Looking for them is much cheaper than the pattern."""
        code = re.match(r"\\\+(\d+)|\\b([A-Z]{2})\\d", self.regex)
        return ("+" + code[1] if code[1] else code[2],) if code else NEEDS.get(self.type, ()) if self.lang is None else ()


NEEDS = {"email": ("@",), "api_key": ("sk-", "AKIA", "ghp_", "gho_", "xoxb-", "xoxp-"), "ipv4_address": (".",), "ipv6_address": (":",), "gps_coordinate": (".",), "mac_address": (":", "-", ".")}


# fixed values: patterns of the nine base types
BASE = [
    Pattern("d1", None, "credit_card", r"\b(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6(?:011|5[0-9]{2}))[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{1,7}\b", "luhn"),
    Pattern("d2", None, "ssn", r"\b[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}\b", "ssn"),
    Pattern("d3", None, "phone", r"(?:\+[0-9]{1,3}[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}|\(?[0-9]{3}\)[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}|\b[0-9]{3}[-.\s][0-9]{3}[-.\s]?[0-9]{4}\b)"),
    Pattern("d4", None, "email", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    Pattern("d5", None, "api_key", r"\b(?:sk-[a-zA-Z0-9][a-zA-Z0-9_-]{19,}|AKIA[0-9A-Z]{14,20}|ghp_[a-zA-Z0-9]{33,}|gho_[a-zA-Z0-9]{33,}|xoxb-[0-9]+-[a-zA-Z0-9]+|xoxp-[0-9]+-[a-zA-Z0-9]+)\b"),
    Pattern("d6", None, "ipv4_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\b", "ipv4"),
    Pattern("d7", None, "ipv6_address", r"(?i:\b[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}\b|\b[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5}::[0-9a-f]{0,4}(?::[0-9a-f]{1,4}){0,5}\b|::(?:[0-9a-f]{1,4}:){0,5}[0-9a-f]{1,4}\b)"),
    Pattern("d8", None, "gps_coordinate", r"-?(?:[1-8]?[0-9]\.[0-9]{4,}|90\.0{4,}),\s*-?(?:1[0-7][0-9]\.[0-9]{4,}|180\.0{4,}|[0-9]{1,2}\.[0-9]{4,})"),
    Pattern("d9", None, "mac_address", r"(?i:\b[0-9a-f]{2}(?::[0-9a-f]{2}){5}\b|\b[0-9a-f]{2}(?:-[0-9a-f]{2}){5}\b|\b[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}\b)"),
]

# fixed values: patterns by language
LANGUAGE = [
    Pattern("l1", "ar", "ssn", r"\b[12]\d{9}\b", "saudi_id", True),
    Pattern("l2", "ar", "ssn", r"\b784[\s-]?\d{4}[\s-]?\d{7}[\s-]?\d\b", "emirates_id", True),
    Pattern("l3", "ar", "phone", r"\+966[\s.-]?5\d[\s.-]?\d{3}[\s.-]?\d{4}\b", None, True),
    Pattern("l4", "ar", "phone", r"\+971[\s.-]?5\d[\s.-]?\d{3}[\s.-]?\d{4}\b", None, True),
    Pattern("l5", "de", "ssn", r"\b\d{11}\b", "german_tax_id", True),
    Pattern("l6", "de", "phone", r"\+49[\s.-]?\d{2,4}[\s.-]?\d{4,8}\b", None, True),
    Pattern("l7", "de", "iban", r"\bDE\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{2}\b", "iban_de", True),
    Pattern("l8", "es", "ssn", r"\b[0-9]{8}-?[A-Za-z]\b", "dni", True),
    Pattern("l9", "es", "ssn", r"\b[XYZxyz]-?[0-9]{7}-?[A-Za-z]\b", "nie", True),
    Pattern("l10", "es", "phone", r"\+34[\s.-]?[0-9]{3}[\s.-]?[0-9]{3}[\s.-]?[0-9]{3}\b", None, True),
    Pattern("l11", "es", "iban", r"\bES\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "iban_es", True),
    Pattern("l12", "fr", "ssn", r"\b[12]\s?\d{2}\s?\d{2}\s?\d{5}\s?\d{3}\s?\d{2}\b", "nir", True),
    Pattern("l13", "fr", "phone", r"\+33[\s.-]?[1-9](?:[\s.-]?\d{2}){4}\b", None, True),
    Pattern("l14", "fr", "phone", r"\b0[1-9](?:[\s.-]?\d{2}){4}\b", None, True),
    Pattern("l15", "fr", "iban", r"\bFR\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{3}\b", "iban_fr", True),
    Pattern("l16", "ja", "ssn", r"\d{4}[\s-]?\d{4}[\s-]?\d{4}", "my_number", True),
    Pattern("l17", "ja", "phone", r"\+81[\s.-]?\d{1,2}[\s.-]?\d{4}[\s.-]?\d{4}", None, True),
    Pattern("l18", "ja", "phone", r"0[789]0[\s.-]?\d{4}[\s.-]?\d{4}", None, True),
    Pattern("l19", "ko", "ssn", r"\d{6}[\s-]?[1-4]\d{6}", "rrn", True),
    Pattern("l20", "ko", "phone", r"\+82[\s.-]?10[\s.-]?\d{4}[\s.-]?\d{4}", None, True),
    Pattern("l21", "ko", "phone", r"010[\s.-]?\d{4}[\s.-]?\d{4}", None, True),
    Pattern("l22", "pt", "ssn", r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "cpf", True),
    Pattern("l23", "pt", "ssn", r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", "cnpj", True),
    Pattern("l24", "pt", "phone", r"\+55[\s.-]?\d{2}[\s.-]?\d{4,5}[\s.-]?\d{4}\b", None, True),
    Pattern("l25", "pt", "phone", r"\+351[\s.-]?\d{3}[\s.-]?\d{3}[\s.-]?\d{3}\b", None, True),
    Pattern("l26", "zh", "ssn", r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", "citizen_id", True),
    Pattern("l27", "zh", "phone", r"\+86[\s.-]?1[3-9]\d[\s.-]?\d{4}[\s.-]?\d{4}", None, True),
    Pattern("l28", "zh", "phone", r"1[3-9]\d[\s.-]?\d{4}[\s.-]?\d{4}", None, True),
]

# fixed values: log scrubbing, in order
SCRUB = [
    (r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b", "[REDACTED-SSN]"),
    (r"\b(?:\d{4}[-\s]?){3,4}\d{1,4}\b", "[REDACTED-CC]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED-EMAIL]"),
    (r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", "[REDACTED-PHONE]"),
    (r"\b(?:sk[-_](?:live|test|proj)[-_])[A-Za-z0-9]{20,}\b", "[REDACTED-KEY]"),
]

# fixed values: persuasion phrases by category, in order of priority
PERSUASION = {
    "Urgency": ["act now", "act fast", "act immediately", "act quickly", "don't wait", "don't delay", "don't hesitate", "don't miss out", "hurry", "hurry up", "right now", "right away", "immediately", "today only", "now or never", "time is running out", "running out of time", "before it's too late", "while you still can", "last chance", "final chance", "final opportunity", "limited time", "limited time offer", "limited time only", "time-sensitive", "urgent", "urgently", "asap", "expires soon", "expiring soon", "offer expires", "deadline approaching", "closing soon", "ending soon", "won't last", "won't last long", "this won't last"],
    "Scarcity": ["only a few left", "limited supply", "limited availability", "limited quantities", "limited edition", "while supplies last", "selling fast", "selling out", "almost gone", "nearly sold out", "exclusive offer", "exclusive deal", "exclusive access", "exclusive opportunity", "one-time offer", "one-time deal", "one-time opportunity", "rare opportunity", "rare chance", "hard to find", "in high demand", "high demand", "going fast", "few remaining", "spots filling up", "limited spots", "limited seats", "first come first served"],
    "Social Proof": ["everyone is", "everyone loves", "everyone agrees", "everyone knows", "most people", "most users", "most customers", "millions of people", "millions of users", "thousands of people", "trusted by millions", "trusted by thousands", "join millions", "join thousands", "people are switching", "people are choosing", "the most popular", "best-selling", "top-rated", "highest-rated", "award-winning", "widely used", "widely adopted", "industry standard", "industry leading", "market leader", "don't be left behind", "you'll be left behind", "everyone else is", "your peers are", "your competitors are", "trending", "viral", "five-star", "five star"],
    "Fear": ["you could lose", "you will lose", "you might lose", "risk of losing", "risk of missing", "fear of missing out", "fomo", "don't fall behind", "falling behind", "left behind", "miss out", "missing out", "you'll regret", "you will regret", "you might regret", "regret not", "can't afford to miss", "can't afford to wait", "at risk", "at serious risk", "dangerous to ignore", "catastrophic", "devastating consequences", "dire consequences", "irreversible damage", "irreversible consequences", "point of no return", "too late", "it may be too late", "before it's too late", "what if you don't", "imagine losing", "think about what happens", "worst case scenario", "you can't afford"],
    "Authority": ["experts agree", "experts recommend", "experts say", "experts suggest", "studies show", "studies prove", "studies confirm", "research shows", "research proves", "research confirms", "scientifically proven", "clinically proven", "clinically tested", "doctor recommended", "doctor approved", "recommended by professionals", "recommended by experts", "endorsed by", "backed by science", "backed by research", "according to experts", "leading authorities", "leading experts", "top experts", "world-renowned", "peer-reviewed", "harvard study", "stanford study", "published research", "as seen on", "featured in", "recognized by", "certified by", "approved by", "trusted by professionals"],
    "Commercial": ["best deal", "best value", "best price", "great deal", "great value", "amazing deal", "incredible deal", "unbeatable price", "unbeatable deal", "lowest price", "save money", "save big", "save now", "huge savings", "massive savings", "discount", "special discount", "special offer", "special price", "special promotion", "free trial", "free shipping", "free bonus", "risk-free", "money back", "money-back guarantee", "satisfaction guaranteed", "no obligation", "no commitment", "cancel anytime", "buy now", "order now", "sign up now", "subscribe now", "get started now", "click here", "click now", "add to cart", "checkout now", "purchase now", "invest in", "invest now", "upgrade now", "premium", "pro version", "unlock", "unlock full"],
    "Flattery": ["smart choice", "smart decision", "wise choice", "wise decision", "great choice", "excellent choice", "perfect choice", "you clearly understand", "you obviously know", "you already know", "as someone who values", "as someone who cares", "as someone who understands", "you deserve", "you deserve the best", "you're worth it", "treat yourself", "reward yourself", "you've earned it", "you've earned this", "savvy", "discerning", "sophisticated", "someone like you", "people like you", "a person of your caliber", "forward-thinking", "ahead of the curve", "early adopter", "thought leader"],
}

# fixed values: phrases that announce personal data in transcripts
SPOKEN = ["social security", "tax id", "taxpayer id", "national id", "government id", "social insurance", "credit card", "card number", "debit card", "visa card", "mastercard", "american express", "expiration date", "security code", "cvv number", "pin number", "bank account", "account number", "routing number", "checking account", "savings account", "wire transfer", "passport number", "driver license", "drivers license", "license number", "birth certificate", "date of birth", "maiden name", "place of birth", "home address", "mailing address", "street address", "full name", "legal name", "phone number", "my address", "call me at", "reach me at", "email address", "contact number", "my email is", "my phone is", "insurance number", "medical record", "health insurance", "patient id", "medicare number", "my password", "verification code"]

# fixed values: default keys whose values are never scanned
SKIPPED_KEYS = ["model", "stream", "temperature", "max_tokens", "top_p", "top_k"]
# fixed values: languages scanned for a detected one
RELATED = {"es": ["es", "pt"], "pt": ["pt", "es"], "fr": ["fr", "es", "pt"], "de": ["de"], "ja": ["ja"], "ko": ["ko"], "zh": ["zh"], "ar": ["ar"]}
# fixed values: upper bounds of the latency histogram in microseconds
LATENCY_BOUNDS = [100, 250, 500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_500_000, 5_000_000, 10_000_000]
# fixed values: usual screen sizes (width, height), desktop, high density and phones
SCREENS = [(1920, 1080), (2560, 1440), (1366, 768), (1440, 900), (1680, 1050), (1280, 720), (1280, 800), (1600, 900), (3840, 2160), (2880, 1800), (3024, 1964), (2560, 1600), (5120, 2880), (3840, 2400), (1170, 2532), (1284, 2778), (1080, 2340), (1080, 2400), (1440, 3200), (1290, 2796)]
