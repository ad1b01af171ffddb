"""Patterns, word lists and thresholds, stated for Java's regex engine.

Every pattern carries ``(?U)`` so that \\w, \\d, \\b and \\s mean their Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that render as nothing.
INVISIBLE = "​﻿‌‍­"
BLANK = INVISIBLE + "\t\n\r\v\f "

# Patterns.
_MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_YEAR = r"(?:19|20)\d{2}"
_DATED = rf"(?:{_MONTH}(?:\s+|-))?{_YEAR}"
_OPEN = r"(?:Present|Current|Now)"
BULLET = r"(?U)^\s*(?:[-+*•●▪◦‣¢]|\d+[.)])[\s​﻿]*"
EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<!\w)\+?\d[\d ()\-.]{6,}\d(?!\w)"
URL = r"(?iuU)(?:https?://[^\s|,;)]+|www\.[^\s|,;)]+|(?<![@\w.-])(?:linkedin|github)\.com/[^\s|,;)]+|(?<![@\w.-])[a-z0-9](?:[a-z0-9-]{0,59}[a-z0-9])(?:\.[a-z]{2,})+(?:/[^\s|,;)]*)?(?![@\w-]|\.[a-z0-9]))"
DATE_RANGE = rf"(?iuU)\b(?:(?:From\s+)?{_YEAR}\s*-\s*(?:{_YEAR}|Present|Current|Now)|(?:From\s+)?{_DATED}(?:\s+-\s+|\s*[–—]\s*|\s+to\s+)(?:{_DATED}|Present|Current|Now))\b"
YEAR = rf"(?U)\b{_YEAR}\b"
DATE = rf"(?iuU)^(?:{_DATED}|{_OPEN})$"
DEGREE = r"(?iuU)\b(?:associate(?:'s)?|bachelor(?:'s)?|master(?:'s)?|doctor(?:ate|al)?|ph\.?\s*d\.?|m\.?\s*(?:sc|s|a|eng|ba)\.?|b\.?\s*(?:sc|s|a|eng|ba)\.?|a\.?\s*(?:a|s)\.?|mba|degree|diploma|certificate|certification|undergraduate|graduate|postgraduate|vocational)\b"
INSTITUTION = r"(?iuU)\b(?:university|college|institute|institution|school|academy|polytechnic|conservatory|seminary|faculty)\b"
GPA = r"(?iuU)\b(c?gpa|grade(?:\s+point\s+average)?)\s*:?[\s-]*(\d+(?:\.\d+)?)(?:\s*(?:/|out\s+of)\s*(\d+(?:\.\d+)?))?\b"
COURSEWORK = r"(?iuU)^\s*(?:relevant\s+)?(?:coursework|courses?|subjects?|modules?)\b"
PAGE_FOOTER = r"(?iuU)\bpage\s+\d+\s*$"
ORDINAL = r"(?U)^\s*(?:\d{1,2}|[IVXivx]{1,4})\s*[.)\]:–—-]?\s+(?=\S)"
COMPANY = r"(?iuU)\b(?:co\.?|company|ltd\.?|limited|inc\.?|corp\.?|corporation|llc|plc)\b|\b(?:group|holdings?|partners|ventures|industries|enterprises|solutions|technologies|systems|services|laboratories|labs)\s*$"
_LABEL = (
    r"date\s+of\s+birth|birth\s+date|d\.?\s*o\.?\s*b\.?|dob|current\s+age|age|gender|sex|marital\s+status|martial\s+status|civil\s+status|marital|"
    r"visa\s+status|visa\s+type|work\s+visa|immigration\s+status|residency\s+visa|work\s+authorization|right\s+to\s+work|visa|nationality|citizenship|"
    r"current\s+residen(?:ce|t)|current\s+location|place\s+of\s+residence|residen(?:ce|t)|current\s+package|annual\s+package|total\s+package|"
    r"compensation\s+package|total\s+compensation|current\s+ctc|ctc|package|current\s+salary|present\s+salary|current\s+income|current\s+pay|"
    r"monthly\s+salary|monthly\s+income|last\s+drawn\s+salary|salary|income"
)
LABELLED = rf"(?iuU)(\b(?:{_LABEL})\b)(?:\s*(?::|[-–—])\s*|\t+|\s+)(.+?)(?=\s*(?:[|•·]|\b(?:{_LABEL})\b)|$)"
GENERIC = r"(?iuU)([A-Za-z][A-Za-z .'/]{1,40}?)\s*(?::|[-–—])\s*(.+?)(?=\s*[|•·]|$)"
INLINE = r"(?U)^([A-Za-z][A-Za-z .'/]{1,40}?)\s*(?::|[-–—])\s*(.+)$"
LOCATION = r"(?U)^[^\d@]{2,48},\s*[^\d@]{2,48}$"
NATIONALITY_CONTEXT = r"(?iuU)\b(?:citizen|citizenship|national|nationality)\b"
NATIONALITY = r"(?iuU)(?:\b[A-Za-z][A-Za-z'-]*(?:\s+[A-Za-z][A-Za-z'-]*)?\s+(?:citizen|national)\b|\b(?:citizenship|nationality)\s*:\s*[A-Za-z][A-Za-z'-]*(?:\s+[A-Za-z][A-Za-z'-]*)?\b)"
SEGMENT = r"(?U)[^|•·]+"
TITLE_SEPARATOR = r"(?U)[|•·]|\s+/\s+"
METADATA_SEPARATOR = r"(?U)\s*(?:[|•·]|–|—|\s-\s)\s*"
KEY_COLON = r"(?U)^([^:\t]{1,60}):\s*(.+)$"
KEY_TAB = r"(?U)^([^\t]{1,60})\t+\s*(.+)$"
KEY_DASH = r"(?U)^(.{1,60}?)\s+(?:-|–|—)\s+(.+)$"
COMPOUND = r"(?iuU)\s*(?:\bas\s+well\s+as\b|\balong\s+with\b|\band\b|\bwith\b|\bplus\b|[&+/|,;])\s*"
AT = r"(?U)\s+@\s+"
SPACED_DASH = r"(?U)\s+[-–—]\s+"

# Language names.
LANGUAGES = (
    "Arabic", "Bahasa Indonesia", "Bahasa Malaysia", "Bengali", "Burmese", "Cantonese", "Chinese", "Czech", "Danish", "Dutch", "English", "Filipino", "Finnish",
    "French", "German", "Greek", "Gujarati", "Hebrew", "Hindi", "Hungarian", "Indonesian", "Italian", "Japanese", "Javanese", "Kannada", "Khmer", "Korean", "Lao",
    "Malay", "Malayalam", "Mandarin", "Marathi", "Nepali", "Norwegian", "Persian", "Polish", "Portuguese", "Punjabi", "Romanian", "Russian", "Sinhala", "Spanish",
    "Swahili", "Swedish", "Tagalog", "Tamil", "Telugu", "Thai", "Turkish", "Ukrainian", "Urdu", "Vietnamese",
)
LANGUAGE = rf"(?iuU)^(?:{'|'.join(LANGUAGES)})(?:\s*\([^)]{{1,30}}\))?$"

# Thresholds.
HEADING_SIMILARITY, HEADING_MARGIN = 0.55, 0.06
HEADING_WORDS, HEADING_CHARS, UPPER_RATIO, HEADING_SIZE = 8, 80, 0.80, 1.12
SUBHEADING_SIZE, SUBHEADING_WORDS, SUBHEADING_CHARS = 1.08, 12, 100
BOUNDARY_SIMILARITY, BOUNDARY_MARGIN, HEADER_LINES = 0.72, 0.08, 16
TITLE_SIMILARITY, TITLE_MARGIN, TITLE_WORDS, TITLE_SEGMENTS = 0.48, 0.06, 10, 3
ATTRIBUTE_SIMILARITY, ATTRIBUTE_MARGIN = 0.62, 0.08
NER_CONFIDENCE = 0.5
LINK_TOLERANCE = 2.0
OCR_MINIMUM = 20


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found in the text."""
    return text.rlike(pattern)


def group(text: Column, pattern: str, n: int) -> Column:
    """Group n of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, n))


def is_language(label: Column) -> Column:
    return F.trim(label).rlike(LANGUAGE)


def is_date(text: Column) -> Column:
    """The whole text is one end of a date range."""
    return strip(text).rlike(DATE)


def strip(text: Column) -> Column:
    """Drops white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
