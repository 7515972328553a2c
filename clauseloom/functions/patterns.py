"""Ordered pattern libraries. Order is semantic: earlier patterns take their matches first."""

from __future__ import annotations

# The words for streets, companies and mail addresses that patterns share.
STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Drive|Dr\.?|Way|Circle|Cir\.?|Court|Ct\.?|Place|Pl\.?|Parkway|Pkwy\.?|Highway|Hwy\.?|Terrace|Ter\.?|Trail|Square|Sq\.?)"

#: Borders of words, beside letters a to z, digits and underscores only, as the SQL and `\w` have them; Java's `\b` counts letters
#: of all scripts. Before or after what always is such a sign, one look is enough.
BEFORE_WORD, AFTER_WORD, BORDER = r"(?<!\w)", r"(?!\w)", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def bordered(pattern: str) -> str:
    """The pattern with its outer `\b` as the borders above."""
    head, tail = (BORDER if pattern.startswith(r"\b[A-Za-z0-9._") else BEFORE_WORD), (BORDER if pattern.endswith((STREET + r"\b", r"|a-z]{2,}\b")) else AFTER_WORD)
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return head * pattern.startswith(r"\b") + inner + tail * pattern.endswith(r"\b")


def spelled(pattern: str) -> str:
    """The pattern with `\b` again, for dialects in which that is a border as above."""
    return pattern.replace(BORDER, r"\b").replace(BEFORE_WORD, r"\b").replace(AFTER_WORD, r"\b")


# The ordered, case-insensitive library of irreversible redaction (label, pattern; `\b` becomes Java's form below).
# Deviation: the words between a house number and its street are bounded, as unbounded ones exhaust Java's stack.
LIBRARY_A: list[tuple[str, str]] = [
    ("TITLE_NAME", r"\b(Dr|Mr|Mrs|Ms|Miss|Prof|Professor|President|CEO|CFO|CTO|Director|Manager|Attorney|Lawyer|Esquire|Esq)\.?\s+([A-Z][a-z]+)"),
    ("VP_NAME", r"\b(Vice\s+President|Senior\s+Vice\s+President|Executive\s+Vice\s+President)\s+([A-Z][a-z]+)"),
    ("ENTITY", r"between\s+([^,]+),?\s+a\s+\w+\s+\w+(?:\s+\w+)?,?\s+and\s+([^,]+),?\s+a\s+\w+\s+\w+(?:\s+\w+)?"),
    ("ENTITY", r"by and between\s+([^,]+),?\s+and\s+([^,]+)"),
    ("CITY_STATE_ZIP", r"\b[A-Z][a-zA-Z\s]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"),
    ("CITY_STATE_ZIP", r"\b[A-Z][a-zA-Z\s]+\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"),
    ("STATE_ZIP", r"\b[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"),
    ("ADDRESS", rf"\b(?:\w+\s+){{0,9}}\d+\s+(?:\w+\s+){{0,20}}{STREET}\b"),
    ("ADDRESS", r"having an address at\s+([^.]+)"),
    ("ADDRESS", r"located at\s+([^,\n]+)"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("SSN", r"\b\d{9}\b"),
    ("TAX_ID", r"\b\d{2}-\d{7}\b"),
    ("ACCOUNT", r"\b(?:Account|Acct)\.?\s*#?\s*\d+\b"),
    ("ACCOUNT", r"\b(?:Account|Acct)\.?\s*[Nn]umber:?\s*\d+\b"),
    ("CREDIT_CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("CREDIT_CARD", r"\b\d{16}\b"),
    ("ROUTING", r"\b(?:Routing|ABA)\.?\s*#?\s*\d{9}\b"),
    ("DRIVERS_LICENSE", r"\b[A-Z]\d{7,8}\b"),
    ("DRIVERS_LICENSE", r"\b\d{8,9}\b"),
    ("AMOUNT", r"\$[\d,]+(?:\.\d{2})?"),
    ("AMOUNT", r"[A-Z][a-z]+\s+[A-Z][a-z]+\s+(?:and\s+\d+/100\s+)?[Dd]ollars?\s+\(\$[\d,]+(?:\.\d{2})?\)"),
    ("PHONE", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("LIMITED_PARTNERSHIP", r"\b([A-Z][a-zA-Z\s&]+)\s+Limited Partnership\b"),
    ("DATE", r"this\s+\d{1,2}(?:st|nd|rd|th)?\s+day of\s+\w+,?\s+\d{4}"),
]
LIBRARY_A = [(label, bordered(p)) for label, p in LIBRARY_A]
#: Three of the patterns begin with a run of letters and blanks. In any case of letters they match from the run's first
#: word or from none of its words, so the forms here don't try a word that follows another (of up to 30 letters and 4
#: blanks): the same matches, in time that grows with the text and not with the square of its runs.
RUN_LABELS = {"CITY_STATE_ZIP": r"\s", "LIMITED_PARTNERSHIP": r"[\s&]"}
FIRST_WORD_ONLY = {p: rf"{BEFORE_WORD}(?<!{BEFORE_WORD}[a-zA-Z]{{1,30}}{RUN_LABELS[label]}{{1,4}})" + p.removeprefix(BEFORE_WORD) for label, p in LIBRARY_A if label in RUN_LABELS}


def in_java(pattern: str, flags: str) -> str:
    """The pattern as Spark shall run it."""
    return flags + (FIRST_WORD_ONLY.get(pattern, pattern) if flags == "(?i)" else pattern)


#: What every match of a slow pattern holds: a text without it needs no search. All hold a sign that no marker holds, or
#: white space beside a letter or digit, so a marker of brackets and word characters can't bring one about.
HELD = {"CITY_STATE_ZIP": r"[A-Z]{2}\s+\d{5}", "LIMITED_PARTNERSHIP": r"\sLimited Partnership", "EMAIL": "@", "ADDRESS": r"\d\s", "AMOUNT": r"\(\$"}
NEEDED = {p: HELD[label] for label, p in LIBRARY_A if label in ("CITY_STATE_ZIP", "LIMITED_PARTNERSHIP", "EMAIL") or (label == "ADDRESS" and STREET in p) or (label == "AMOUNT" and r"\(\$" in p)}
#: Matches nothing.
NEVER = r"\A(?!)"

#: The patterns of digits and signs only, which all regular-expression dialects read alike.
PLAIN_LABELS = ("SSN", "TAX_ID", "CREDIT_CARD", "AMOUNT", "PHONE", "EMAIL")
PLAIN: list[tuple[str, str]] = [(label, p) for label, p in LIBRARY_A if label in PLAIN_LABELS and "Dollars" not in p and "ollars" not in p]

# Fixed values, as above.
COMPANY_SUFFIX = r"(?:LLC|L\.L\.C\.|Inc\.?|Corp\.?|Corporation|Company|Co\.|LP|L\.P\.|LLP|Associates|Group|Center|Centre|Clinic|Lab|Laboratory|Foundation|Trust|Fund|Enterprises|Holdings|Services|Solutions|Properties|Realty|Management|Consulting|International|Limited|Ltd\.?)"
STREET_B = r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Drive|Dr\.?|Lane|Ln\.?|Court|Ct\.?|Boulevard|Blvd\.?|Way|Place|Pl\.?|Circle|Cir\.?|Parkway|Pkwy\.?|Highway|Hwy\.?|STREET|ST|AVENUE|AVE|ROAD|RD|DRIVE|DR|LANE|LN|COURT|CT|BOULEVARD|BLVD)"

# The ordered, case-sensitive library of reversible redaction.
LIBRARY_B: list[tuple[str, str]] = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\(\d{3}\)\s*\d{3}-\d{4}"),
    ("PHONE", r"\d{3}-\d{3}-\d{4}"),
    ("COMPANY", r"\b\d+\s+[A-Za-z][A-Za-z\s&,.-]{1,40},?\s*" + COMPANY_SUFFIX + r"\b"),
    ("COMPANY", r"\b[A-Z][A-Za-z\s&,.-]{1,50},?\s*" + COMPANY_SUFFIX + r"\b"),
    ("ADDRESS", r"\b\d+\s+[A-Za-z]+\s+" + STREET_B + r"(?:\s*,?\s*(?:Suite|Ste\.?|Apt\.?|Unit|#|SUITE|STE|APT|UNIT)\s*\w+)?(?:\s*,\s*[A-Za-z]+(?:\s+[A-Za-z]+)*)?(?:\s*,\s*[A-Z]{2})?\s*\d{5}(?:-\d{4})?\b"),
    ("STREET", r"\b\d+\s+[A-Za-z]+\s+" + STREET_B + r"\b"),
    ("ZIP", r"\b\d{5}(?:-\d{4})?\b"),
    ("DATE", r"\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("DATE", r"\b\d{1,2}-\d{1,2}-\d{4}\b"),
    ("PERSON", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
]

# Fixed values, as above.
STREET_WORD = r"(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Boulevard|Blvd)"
MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"

# The earlier, case-sensitive library of reversible redaction.
LIBRARY_B0: list[tuple[str, str]] = [
    ("EMAIL", MAIL),
    ("PHONE", r"\(\d{3}\)\s*\d{3}-\d{4}"),
    ("PHONE", r"\d{3}-\d{3}-\d{4}"),
    ("ADDRESS", r"\b\d+\s+[A-Z][a-z]+\s+" + STREET_WORD + r"(?:\s*,\s*[A-Z][a-z]+)?(?:\s*,\s*[A-Z]{2})?\s*\d{5}?\b"),
    ("STREET", r"\b[A-Z][a-z]+\s+" + STREET_WORD + r"\b"),
    ("ZIP", r"\b\d{5}(?:-\d{4})?\b"),
    ("COMPANY", r"\b[A-Z][A-Za-z\s&]+(?:LLC|Inc|Corp|Corporation|Company|Co\.)\b"),
    ("DATE", r"\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("DATE", r"\b\d{1,2}-\d{1,2}-\d{4}\b"),
    ("PERSON", r"\b(?!Real|Estate|This|Agreement|Property|Information|Party|Buyer|Seller|Company)[A-Z][a-z]+ [A-Z][a-z]+\b"),
]

# The library of counted placeholders, and the terms that keep a match from being one.
LIBRARY_C: list[tuple[str, str]] = [
    ("COMPANY", r"\b[A-Z][A-Z\s&,\.]{3,}(?:LLC|INC|CORP|LP|LLP|COMPANY|CO\.)\b"),
    ("ADDRESS", r"\d+\s+[A-Za-z\s]+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Boulevard|Blvd|Lane|Ln)[^,\n]*"),
    ("DATE", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b"),
    ("NAME", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"),
]
LIBRARY_C_CONTACT: list[tuple[str, str]] = [*LIBRARY_C, ("PHONE", r"\b\d{3}-\d{3}-\d{4}\b"), ("EMAIL", MAIL)]
STOP_TERMS_C = ["party", "agreement", "information", "confidential", "broker", "seller"]
STOP_TERMS_C_BRIEF = ["party", "agreement", "information", "confidential"]
STOP_TERMS_C_FIRST = ["party", "agreement", "information"]
STOP_TERMS_C_CONTACT = ["party", "agreement", "information", "confidential", "receiving", "disclosing"]

# The small library for trials.
LIBRARY_T: list[tuple[str, str]] = [
    ("NAME", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
    ("ADDRESS", r"\b\d{1,5}\s+[A-Za-z\s]+" + STREET_WORD + r"\b"),
    ("EMAIL", MAIL),
    ("PHONE", r"\(\d{3}\)\s*\d{3}-\d{4}"),
    ("ZIP", r"\b\d{5}(?:-\d{4})?\b"),
]

# Signs of pages that hold markup or encoded data.
GARBAGE_MARKERS = ["@font-face", "chrome-extension", "multipartboundary", "content-type:", "content-location:", "woff2", 'format("woff")', "font-family:", "font-weight:", "font-style:"]
