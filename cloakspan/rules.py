"""Fixed detection values: types, patterns, keyword lists, name lists, templates.

Everything in this module is data.  Patterns are written once in the common
regex subset and get their Spark (Java) flags from :func:`java_regex`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from string import ascii_letters, digits

# ---------------------------------------------------------------------------
# The PII types, the arbitration priority of each and the
# placeholder template of each ({n} counts from 1 per scope and type).
# ---------------------------------------------------------------------------

TYPE_PRIORITY = {
    "email": 10,
    "phone": 10,
    "slack_handle": 8,
    "person_name": 7,
    "company_name": 6,
    "project_name": 5,
    "team_name": 5,
    "address": 4,
    "ssn": 10,
    "credit_card": 10,
    "ip_address": 9,
    "url": 9,
    "date_of_birth": 3,
    "custom": 2,
}

PII_TYPES = tuple(TYPE_PRIORITY)

PLACEHOLDER_TEMPLATES = {
    "email": "person{n}@example.com",
    "phone": "555-000-{n:04d}",
    "slack_handle": "@user{n}",
    "person_name": "Person {n}",
    "company_name": "Company {n}",
    "project_name": "Project Alpha {n}",
    "team_name": "Team {n}",
    "address": "{n} Example Street, Anytown, ST 12345",
    "ssn": "XXX-XX-{n:04d}",
    "credit_card": "XXXX-XXXX-XXXX-{n:04d}",
    "ip_address": "192.0.2.{n}",
    "url": "https://example.com/page{n}",
    "date_of_birth": "1990-01-{n:02d}",
    "custom": "[REDACTED-{n}]",
}

# The first placeholders of these two types come from a list.
PLACEHOLDER_NAMES = (
    "John Doe", "Jane Smith", "Bob Johnson", "Alice Williams",
    "Charlie Brown", "Diana Prince", "Edward Norton", "Fiona Green",
    "George Miller", "Helen Davis", "Ivan Petrov", "Julia Roberts",
    "Kevin White", "Laura Black", "Michael Grey", "Nancy Blue",
    "Oliver Stone", "Patricia Gold", "Quincy Silver", "Rachel Bronze",
)

PLACEHOLDER_COMPANIES = (
    "Example Corp", "Acme Inc", "Sample LLC", "Demo Industries",
    "Test Company", "Placeholder Ltd", "Generic Solutions", "Standard Co",
    "Universal Enterprises", "Global Services", "Alpha Technologies",
    "Beta Systems", "Gamma Holdings", "Delta Partners", "Epsilon Group",
)

PLACEHOLDER_LISTS = {
    "person_name": PLACEHOLDER_NAMES,
    "company_name": PLACEHOLDER_COMPANIES,
}

# Thresholds and layer numbers.
AUTO_THRESHOLD = 0.75
LEARNED_CONFIDENCE = 1.0
CUSTOM_CONFIDENCE = 0.90
CONTEXTUAL_CONFIDENCE = 0.60
CONTEXT_CHARS = 50
SESSION_HOURS = 1

LAYER_LEARNED = 1
LAYER_REGEX = 2
LAYER_CUSTOM = 3
LAYER_ENTITY = 4
LAYER_NAMES = 5
LAYER_CONTEXTUAL = 6  # opt-in, uncertain like the name layer


# Word characters are letters, numbers and '_' (marks and joiners are not), and
# white space includes the separators U+001C to U+001F.  The letter U+1D400 makes
# a look-behind read whole code points.
_WORD = "[\\p{L}\\p{N}_\U0001d400]"
_BORDER = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_SPACE = r"\s\x1c-\x1f"


def java_regex(pattern: str, ignore_case: bool, guard: str = "") -> str:
    """The pattern for Spark's regex engine: flags for Unicode classes and case,
    and the word border and white space of the pattern's definition.

    ``guard`` is a condition that every start of a hit meets; it is tested first
    because it is cheaper than a word border.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\b" and not in_class:
            out.append(_BORDER)
        elif pair == r"\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
        elif pair[0] == "\\":
            out.append(pair)
        else:
            in_class = pair[0] == "[" or (in_class and pair[0] != "]")
            out.append(pair[0])
        i += 2 if pair[0] == "\\" else 1
    return ("(?iuU)" if ignore_case else "(?U)") + guard + "".join(out)


@dataclass(frozen=True)
class Rule:
    """One pattern of a detection layer.

    ``gate`` is a cheap necessary condition (a literal that must occur, or a
    short regex) which keeps clean text away from the full pattern; ``guard`` is
    one for the position of a hit.  ``in_windows`` says that the pattern may be
    searched in the windows of :mod:`cloakspan.functions.windows`.
    """

    name: str
    pii_type: str
    pattern: str
    confidence: float
    layer: int
    seq: int
    ignore_case: bool = True
    gate_literal: str | None = None
    gate_regex: str | None = None
    guard: str = ""
    in_windows: bool = False

    @property
    def regex(self) -> str:
        return java_regex(self.pattern, self.ignore_case, self.guard)


_THREE_DIGITS = r"(?U)\d{3}"

# The built-in patterns with their confidence, in claim order.
REGEX_RULES = (
    Rule("email", "email",
         r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
         0.95, LAYER_REGEX, 0, gate_literal="@",
         guard=r"(?:\b|(?<=[^\x00-\x7f]))(?=[A-Za-z0-9._%+-]++@)", in_windows=True),
    Rule("phone", "phone",
         r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
         0.85, LAYER_REGEX, 1, gate_regex=_THREE_DIGITS,
         guard=r"(?=(?-iu:[+(0123456789]))", in_windows=True),
    Rule("slack_handle", "slack_handle",
         r"(?<![A-Za-z0-9._%+-])@[A-Za-z][A-Za-z0-9_-]{0,20}(?![A-Za-z0-9.])\b",
         0.80, LAYER_REGEX, 2, gate_literal="@", guard="(?=@)", in_windows=True),
    Rule("ssn", "ssn",
         r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b",
         0.90, LAYER_REGEX, 3, gate_regex=_THREE_DIGITS, guard=r"(?=\d)", in_windows=True),
    Rule("credit_card", "credit_card",
         r"\b(?:\d{4}[-.\s]?){3}\d{4}\b",
         0.85, LAYER_REGEX, 4, gate_regex=_THREE_DIGITS, guard=r"(?=\d)", in_windows=True),
    Rule("ip_address", "ip_address",
         r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
         0.90, LAYER_REGEX, 5, gate_regex=r"(?U)\d\.\d", guard=r"(?=\d)", in_windows=True),
    Rule("url", "url",
         r"https?://[^\s<>\"{}|\\^`\[\]]+",
         0.95, LAYER_REGEX, 6, gate_literal="://", in_windows=True),
)

RULES_BY_NAME = {rule.name: rule for rule in REGEX_RULES}

# Two capitalised words, Latin or Cyrillic.
NAME_PATTERN = (
    r"\b([A-ZА-ЯҐЄІЇ][a-zа-яґєії']+)\s+([A-ZА-ЯҐЄІЇ][a-zа-яґєії']+)\b"
)
NAME_GUARD = "(?=[A-ZА-ЯҐЄІЇ])"
NAME_BOTH_KNOWN = 0.70
NAME_ONE_KNOWN = 0.60
NAME_NONE_KNOWN = 0.50

# Keywords that announce a value of the type, in list order.
CONTEXT_KEYWORDS = {
    "person_name": (
        "mr", "mrs", "ms", "dr", "prof", "dear", "hi", "hello",
        "regards", "sincerely", "from", "to", "cc", "bcc",
        "employee", "manager", "director", "ceo", "cto", "cfo",
        "пан", "пані", "панна", "др", "проф", "шановний", "шановна",
        "вітаю", "привіт", "з повагою", "від", "кому", "до",
        "працівник", "менеджер", "директор", "керівник", "начальник",
        "співробітник", "колега", "представник", "голова", "заступник",
    ),
    "company_name": (
        "inc", "llc", "ltd", "corp", "company", "enterprise",
        "client", "customer", "partner", "vendor", "supplier",
        "тов", "пп", "ат", "пат", "зат", "фоп", "компанія", "підприємство",
        "організація", "корпорація", "холдинг", "група", "клієнт",
        "замовник", "партнер", "постачальник", "контрагент",
    ),
    "project_name": (
        "project", "initiative", "program", "campaign", "sprint",
        "milestone", "release", "version", "phase",
        "проект", "ініціатива", "програма", "кампанія", "спринт",
        "етап", "реліз", "версія", "фаза",
    ),
    "team_name": (
        "team", "squad", "group", "department", "division",
        "unit", "org", "organization",
        "команда", "група", "відділ", "департамент", "підрозділ",
        "сектор", "управління", "служба",
    ),
}

# The phrase after a keyword.  The repeated part is possessive:
# nothing follows it, so the hits are the same and long runs need no recursion.
CONTEXT_PHRASE = (
    r"([A-ZА-ЯҐЄІЇ][A-Za-zА-Яа-яґєіїҐЄІЇ']+"
    r"(?:\s+[A-ZА-ЯҐЄІЇ][A-Za-zА-Яа-яґєіїҐЄІЇ']+)*+)"
)


def contextual_pattern(pii_type: str) -> str:
    words = "|".join(CONTEXT_KEYWORDS[pii_type])
    return rf"\b({words})\b[:\s]+" + CONTEXT_PHRASE


def _folded(char: str) -> str:
    upper = char.upper() if len(char.upper()) == 1 else char
    return upper.lower()[0]


@cache
def _cases() -> dict[str, str]:
    """The characters that are equal under case-blind matching."""
    out: dict[str, str] = {}
    for char in map(chr, (*range(0xD800), *range(0xE000, 0x10000))):
        out[_folded(char)] = out.get(_folded(char), "") + char
    return out


def any_case(chars: Iterable[str]) -> str:
    """A class of ``chars`` in all their cases, to be read without regard to flags."""
    found = {case for char in chars for case in _cases()[_folded(char)]}
    return "[" + "".join(re.escape(c) for c in sorted(found)) + "]"


@cache
def contextual_guard(pii_type: str) -> str:
    """What stands at the start of a keyword: its first two letters, and no letter
    or digit before them.  The single characters are a table look-up."""
    seconds: dict[str, set[str]] = {}
    for word in CONTEXT_KEYWORDS[pii_type]:
        seconds.setdefault(word[0], set()).add(word[1])
    pairs = "|".join(any_case(first) + any_case(second) for first, second in seconds.items())
    before = f"[{ascii_letters}{digits}_]"
    return f"(?=(?-iu:{any_case(seconds)}))(?<!(?-iu:{before}))(?=(?-iu:{pairs}))"


# Entity labels of a user's model -> (type, confidence).
ENTITY_LABELS = {
    "PERSON": ("person_name", 0.90),
    "ORG": ("company_name", 0.85),
    "GPE": ("address", 0.60),
    "LOC": ("address", 0.60),
    "DATE": ("date_of_birth", 0.50),
    "PRODUCT": ("project_name", 0.80),
    "WORK_OF_ART": ("project_name", 0.75),
}

# Entity texts that are never PII (lower case).
ENTITY_STOP_WORDS = (
    "ip", "ssn", "api", "url", "email", "phone", "address", "client",
    "contact", "team", "project", "internal", "slack", "channel",
    "employee", "corporate", "card", "best", "regards", "from", "to",
    "cc", "date", "summary", "executive", "technical", "details",
    "confidential", "notes", "information", "members",
    "проект", "команда", "клієнт", "контакт", "адреса", "телефон",
    "інформація", "дата", "деталі", "учасники", "працівник", "відділ",
    "компанія", "організація", "договір", "угода", "документ", "звіт",
    "замовник", "виконавець", "сторона", "предмет", "умови", "стаття",
    "пункт", "розділ", "додаток", "підпис", "печатка", "реквізити",
)

# Fixed values used by the entity clean-up.
ENTITY_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
ENTITY_PERSON_RUN = (
    r"^([A-ZА-ЯҐЄІЇ][a-zа-яґєії']+(?:\s+[A-ZА-ЯҐЄІЇ][a-zа-яґєії']+)*+)"
)
ENTITY_PERSON_MAX_WORDS = 3
ENTITY_ORG_PREFIXES = ("project ", "client ", "internal ")
ENTITY_ORG_MARKERS = (
    "inc", "corp", "llc", "ltd", "industries", "tech", "company",
)

# Common first names (lower case).
FIRST_NAMES = (
    "james", "john", "robert", "michael", "william", "david", "richard",
    "joseph", "thomas", "charles", "mary", "patricia", "jennifer", "linda",
    "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "nancy",
    "lisa", "betty", "margaret", "sandra", "ashley", "dorothy", "kimberly",
    "emily", "donna", "michelle", "daniel", "matthew", "anthony", "mark",
    "donald", "steven", "paul", "andrew", "joshua", "kenneth", "kevin",
    "brian", "george", "edward", "ronald", "timothy", "jason", "jeffrey",
    "ryan", "jacob", "gary", "nicholas", "eric", "jonathan", "stephen",
    "larry", "justin", "scott", "brandon", "benjamin", "samuel", "raymond",
    "gregory", "frank", "alexander", "patrick", "jack", "dennis", "jerry",
    "олександр", "андрій", "артем", "богдан", "василь", "віктор", "віталій",
    "володимир", "дмитро", "євген", "іван", "ігор", "максим", "микола",
    "михайло", "назар", "олег", "павло", "петро", "роман", "руслан",
    "сергій", "степан", "тарас", "юрій", "ярослав", "денис", "костянтин",
    "анна", "вікторія", "галина", "дарина", "ірина", "катерина", "лариса",
    "людмила", "марія", "наталія", "оксана", "олена", "ольга", "світлана",
    "соломія", "софія", "тетяна", "юлія", "яна", "валентина", "надія",
    "леся", "христина", "зоряна", "любов", "анастасія", "діана", "аліна",
)

# Common last names (lower case).
LAST_NAMES = (
    "smith", "johnson", "williams", "brown", "jones", "garcia", "miller",
    "davis", "rodriguez", "martinez", "hernandez", "lopez", "gonzalez",
    "wilson", "anderson", "thomas", "taylor", "moore", "jackson", "martin",
    "lee", "perez", "thompson", "white", "harris", "sanchez", "clark",
    "ramirez", "lewis", "robinson", "walker", "young", "allen", "king",
    "wright", "scott", "torres", "nguyen", "hill", "flores", "green",
    "adams", "nelson", "baker", "hall", "rivera", "campbell", "mitchell",
    "carter", "roberts", "gomez", "phillips", "evans", "turner", "diaz",
    "шевченко", "бондаренко", "коваленко", "бойко", "ткаченко", "кравченко",
    "олійник", "шевчук", "поліщук", "бондар", "ткачук", "мельник", "мороз",
    "лисенко", "савченко", "руденко", "петренко", "кузьменко", "павленко",
    "марченко", "іваненко", "левченко", "клименко", "пономаренко", "гончаренко",
    "литвиненко", "гриценко", "кравчук", "сидоренко", "федоренко", "тимченко",
    "ковальчук", "костенко", "даниленко", "козак", "гончар", "швець", "хоменко",
    "панченко", "кравець", "юрченко", "василенко", "харченко", "романенко",
)

# File extensions and the family that reads them.
EXTENSION_FAMILY = {
    ".docx": "docx",
    ".pdf": "pdf",
    ".txt": "text",
    ".text": "text",
    ".md": "text",
    ".markdown": "text",
    ".xlsx": "xlsx",
    ".xlsm": "xlsx",
    ".pptx": "pptx",
}

# Separators put between the parts of an extracted document.
PAGE_SEPARATOR = "\n\n--- Page Break ---\n\n"
SHEET_HEADER = "--- Sheet: %s ---"
SLIDE_HEADER = "--- Slide %s ---"
NOTES_PREFIX = "[Notes] "

# Key derivation.
KDF_ROUNDS = 480_000
KDF_SALT_BYTES = 16
KDF_KEY_BYTES = 32
MAPPING_VERSION = 1
LEARNED_VERSION = 1
# the engine's own form, a row for each value
LEARNED_ROWS_VERSION = 2
