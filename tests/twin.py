"""A plain-Python model of the expected results, for comparison in tests."""

from __future__ import annotations

import re
from itertools import groupby

from cloakspan import rules as R


def raw_spans(text, names=True, custom=(), learned=(), safe=()):
    """(start, end, layer, seq, text, type, confidence) of every layer."""
    out = []
    for seq, (kind, value) in enumerate(learned):
        for m in re.finditer(re.escape(value), text, re.I):
            out.append((*m.span(), 1, seq, m[0], kind, 1.0))
    for rule in R.REGEX_RULES:
        for m in re.finditer(rule.pattern, text, re.I):
            out.append((*m.span(), 2, rule.seq, m[0], rule.pii_type, rule.confidence))
    for seq, (pattern, kind, confidence) in enumerate(custom):
        for m in re.finditer(pattern, text):
            out.append((*m.span(), 3, seq, m[0], kind, confidence))
    if names:
        for m in re.finditer(R.NAME_PATTERN, text):
            known = (m[1].lower() in R.FIRST_NAMES) + (m[2].lower() in R.LAST_NAMES)
            out.append((*m.span(), 5, 0, m[0], "person_name", (0.5, 0.6, 0.7)[known]))
    return [s for s in out if s[2] == 1 or s[4].lower() not in safe]


def claims(spans):
    ordered = sorted(spans, key=lambda s: s[:4])
    return [next(group) for _, group in groupby(ordered, key=lambda s: s[:2])]


def is_match(span):
    return span[2] == 1 or (span[2] < 5 and span[6] >= R.AUTO_THRESHOLD)


def resolve(spans, order, repeats):
    def rank(s):
        start, end, layer, seq, text, kind, confidence = s
        prio = R.TYPE_PRIORITY[kind]
        if order == "reference":
            return (-confidence, -prio, len(text), layer, seq, start)
        return (-len(text), -confidence, -prio, start, layer, seq)

    kept = []
    for s in sorted(spans, key=rank):
        clash = any(s[0] < k[1] and k[0] < s[1] for k in kept)
        seen = repeats == "first" and any(k[4] == s[4] for k in kept)
        if not clash and not seen:
            kept.append(s)
    return sorted(kept)


def detect(text, order="longest", repeats="all", **layers):
    found = claims(raw_spans(text, **layers))
    return (
        resolve([s for s in found if is_match(s)], order, repeats),
        resolve([s for s in found if not is_match(s)], order, repeats),
    )


def placeholder(kind, n):
    words = R.PLACEHOLDER_LISTS.get(kind, ())
    return words[n - 1] if n <= len(words) else R.PLACEHOLDER_TEMPLATES[kind].format(n=n)


class Mapping:
    def __init__(self):
        self.by_key, self.count, self.restorations = {}, {}, {}

    def add(self, text, kind):
        key = (kind, text.lower())
        if key not in self.by_key:
            self.count[kind] = self.count.get(kind, 0) + 1
            self.by_key[key] = placeholder(kind, self.count[kind])
            self.restorations[self.by_key[key]] = text
        return self.by_key[key]


def redact_safe(text, accept_all=False, mapping=None, **layers):
    matches, uncertain = detect(text, **layers)
    chosen = matches
    if accept_all:
        chosen = resolve(matches + uncertain, "longest", "all")
    mapping = mapping or Mapping()
    out, at = [], 0
    for s in chosen:
        out += [text[at:s[0]], mapping.add(s[4], s[5])]
        at = s[1]
    return "".join(out) + text[at:], len(chosen), len(uncertain), mapping


def redact_reference(text, accept_all=False, mapping=None, **layers):
    matches, uncertain = detect(text, "reference", "first", **layers)
    chosen = matches + (uncertain if accept_all else [])
    mapping = mapping or Mapping()
    out = text
    for s in sorted(chosen, key=lambda s: s[0], reverse=True):
        out = out[: s[0]] + mapping.add(s[4], s[5]) + out[s[1]:]
    return out, len(chosen), len(uncertain), mapping


def restore_sequential(text, restorations):
    count = 0
    for mark, original in restorations.items():
        count += text.count(mark)
        text = text.replace(mark, original)
    return text, count
