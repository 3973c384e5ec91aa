"""Names, patterns and numbers that results depend on.

Everything here is data that tokens, spans or scores are defined by.  Changing
any of it changes results, so it is kept together and in plain text.
"""

from __future__ import annotations

# Entity vocabulary.
ENTITIES = (
    "PERSON",
    "EMAIL_ADDRESS",
    "PHONE_NUMBER",
    "US_SSN",
    "CREDIT_CARD",
    "IP_ADDRESS",
    "LOCATION",
    "URL",
    "DATE_TIME",
    "IBAN_CODE",
    "CRYPTO",
)

# Built-in rules in RE2 spelling, in rule order.
RULE_PATTERNS = {
    "EMAIL_ADDRESS": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{4}\b",
    "PHONE_NUMBER": r"\b(?:\+?\d{1,3}[ .\-]?)?(?:\(\d{3}\)|\d{3})[ .\-]\d{3}[ .\-]\d{4}\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "URL": r"\bhttps?://[^\s]+",
}
RULE_SCORE = 1.0
DICTIONARY_SCORE = 0.9

# Token format: [[CMPL_<ENTITY>_<16 hex digits>]].
TOKEN_MARKER = "[[CMPL_"
TOKEN_SUFFIX = "]]"
TOKEN_ID_LENGTH = 16
# No token is longer than 128 bytes, so a label has at most 102 characters: the
# same bound holds where tokens are made, found, and held back in streams.
TOKEN_MAX_BYTES = 128
TOKEN_LABEL_LENGTH = 102
TOKEN_PATTERN = r"\[\[CMPL_[A-Z0-9_]{1,102}_[0-9a-f]{16}\]\]"
FALLBACK_ENTITY = "PII"

# Inspect-provider info types by entity name.
INSPECT_INFO_TYPES = {
    "PERSON": "PERSON_NAME",
    "EMAIL_ADDRESS": "EMAIL_ADDRESS",
    "PHONE_NUMBER": "PHONE_NUMBER",
    "US_SSN": "US_SOCIAL_SECURITY_NUMBER",
    "CREDIT_CARD": "CREDIT_CARD_NUMBER",
    "IP_ADDRESS": "IP_ADDRESS",
    "LOCATION": "LOCATION",
    "URL": "URL",
    "IBAN_CODE": "IBAN_CODE",
}

# Inspect-provider likelihood names and their scores.
LIKELIHOOD_SCORES = {
    "VERY_LIKELY": 0.9,
    "LIKELY": 0.7,
    "POSSIBLE": 0.5,
    "UNLIKELY": 0.3,
    "VERY_UNLIKELY": 0.1,
}
UNKNOWN_LIKELIHOOD_SCORE = 0.5

# Defaults.
DEFAULT_LANGUAGE = "en"
DEFAULT_THRESHOLD = 0.5
DEFAULT_TTL_SECONDS = 24 * 60 * 60

# Unicode white space, as the body of a regex character class.
WHITE_SPACE = r"\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
