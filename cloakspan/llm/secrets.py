"""Secret scans: named patterns, and a randomness test battery on tokens.

Three patterns find assigned secrets, access keys and long hexadecimal runs.
Beside them every long token of letters, digits and ``+/_-`` is tested for
being random under its inferred encoding:

* chi-squared: are the symbols of the encoding's alphabet equally frequent?
* runs: do the upper and the lower half of the alphabet alternate by chance?
* serial correlation: is a symbol's place in the alphabet independent of the one before?

A token that fails one of them (with Bonferroni's correction) is not random.
For the others the chance that ordinary text of the same length and encoding
spreads over the alphabet as evenly is the p-value of a discovery: it shrinks
with length, as the chi-squared statistic of text grows with it.  Benjamini and
Hochberg's rule, applied to each encoding and length class over the whole
corpus, bounds the share of false discoveries.

All work is Spark SQL.  Two narrow scans: one counts p-values by class (some
thousand rows at most), one places the spans; texts are never shuffled.

Defined cases: a null text counts as empty; an empty text has no spans; repeated
rows are scanned each; further columns are kept by ``redact`` and ``scan``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakspan.functions.expr import (
    Sql,
    compute_once,
    concat,
    empty,
    exists,
    fold,
    keep,
    let,
    running,
    struct,
    text_literal,
    transform,
)
from cloakspan.functions.spans import regex_hits

#: The given patterns, fixed values.
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "random")

#: Tokens that are tested, and the padding after them.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order of inference: pattern of the token, alphabet, and the
#: chance that two symbols of ordinary text in this encoding are equal.
ENCODINGS = (
    ("hex", "^[0-9]*[a-f][0-9a-f]*$", _DIGITS + "abcdef", 0.13),
    ("HEX", "^[0-9]*[A-F][0-9A-F]*$", _DIGITS + "ABCDEF", 0.13),
    ("base32", "^[A-Z2-7]*[A-Z][A-Z2-7]*$", _UPPER + "234567", 0.065),
    ("alnum", "^[0-9]*[A-Za-z][A-Za-z0-9]*$", _UPPER + _LOWER + _DIGITS, 0.055),
    ("base64", "^[A-Za-z0-9+/]*[A-Za-z][A-Za-z0-9+/]*$", _UPPER + _LOWER + _DIGITS + "+/", 0.055),
    ("base64url", "^[A-Za-z0-9_-]*[A-Za-z][A-Za-z0-9_-]*$", _UPPER + _LOWER + _DIGITS + "-_", 0.055),
)

#: Least battery p-value of a random token, and share of false discoveries.
BATTERY_LEVEL, FALSE_SHARE = 1e-3, 0.01
#: p-values are counted in steps of a power of ten.
STEPS, MOST_STEPS = 8, 400

SPAN = "struct<start:int,kind:int,end:int>"
MARK = "[SECRET]"


# --- the battery ----------------------------------------------------------


def _upper_tail(z: Sql) -> Sql:
    """P(Z > z) of the standard normal, by Abramowitz and Stegun's 26.2.17."""
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

    def tail(x: Sql) -> Sql:
        t = f"(1 / (1 + 0.2316419 * {x}))"
        polynomial = "0"
        for c in reversed(terms):
            polynomial = f"({c}D + t * {polynomial})" if polynomial != "0" else f"{c}D"
        body = f"t -> exp(-{x} * {x} / 2) / {math.sqrt(2 * math.pi)!r}D * t * {polynomial}"
        return f"element_at(transform(array({t}), {body}), 1)"

    return let(
        f"cast({z} AS double)",
        lambda v: f"if({v} >= 0, {let(f'abs({v})', tail)}, 1 - {let(f'abs({v})', tail)})",
    )


def _battery(token: Sql) -> Sql:
    """``struct<encoding, size, p_random, p_text>`` of a token, null if no
    encoding fits it."""

    def measured(core: Sql, number: int) -> Sql:
        name, _, alphabet, match = ENCODINGS[number]
        size = len(alphabet)
        symbols = text_literal(alphabet)
        halves = text_literal("0" * (size // 2) + "1" * (size - size // 2))
        letters = f"transform(split({symbols}, ''), s -> s)"
        counted = fold(
            f"filter({letters}, s -> s != '')",
            "0D",
            lambda acc, s: f"{acc} + power(length({core}) - length(replace({core}, {s}, '')), 2)",
        )
        places = transform(
            f"filter(split({core}, ''), c -> c != '')",
            lambda c: f"cast(instr({symbols}, {c}) AS double)",
        )

        def with_counts(n: Sql) -> Sql:
            chi = f"({counted} * {size}D / {n} - {n})"
            # Wilson and Hilferty: the cube root is close to normal
            spread = f"(2D / {9 * (size - 1)})"
            chi_z = f"((pow({chi} / {size - 1}, 1D / 3) - (1 - {spread})) / sqrt({spread}))"
            bits = f"translate({core}, {symbols}, {halves})"

            def runs_p(b: Sql) -> Sql:
                ones = f"(length({b}) - length(replace({b}, '1', '')))"
                turns = (
                    f"((length({b}) - length(replace({b}, '01', ''))) div 2 + "
                    f"(length({b}) - length(replace({b}, '10', ''))) div 2 + 1)"
                )

                def given(k: Sql) -> Sql:
                    other = f"({n} - {k})"
                    mean = f"(2D * {k} * {other} / {n} + 1)"
                    spread = f"(({mean} - 1) * ({mean} - 2) / ({n} - 1))"
                    z = f"(abs({turns} - {mean}) / sqrt({spread}))"
                    return f"if({spread} > 0, 2 * {_upper_tail(z)}, 0D)"

                return let(f"cast({ones} AS double)", given)

            def serial_p(v: Sql) -> Sql:
                mean = f"(aggregate({v}, 0D, (a, x) -> a + x) / {n})"

                def centred(d: Sql) -> Sql:
                    own = f"aggregate({d}, 0D, (a, x) -> a + x * x)"
                    next_one = f"slice({d}, 2, size({d}))"
                    lagged = (
                        f"aggregate(zip_with({d}, {next_one}, (x, y) -> "
                        f"coalesce(x * y, 0D)), 0D, (a, x) -> a + x)"
                    )
                    z = f"(abs({lagged} / {own} + 1D / {n}) * sqrt({n}))"
                    return f"if({own} > 0, 2 * {_upper_tail(z)}, 0D)"

                return let(
                    mean, lambda m: let(transform(v, lambda x: f"{x} - {m}"), centred)
                )

            excess = size * match - 1
            mean = f"({size - 1}D + ({n} - 1) * {excess!r}D)"
            spread = f"sqrt({2 * (size - 1)}D + 4 * ({n} - 1) * {excess!r}D)"
            p_text = _upper_tail(f"(({mean} - {chi}) / {spread})")
            p_random = (
                f"least(1D, 3 * least({_upper_tail(chi_z)}, "
                f"{let(bits, runs_p)}, {let(places, serial_p)}))"
            )
            return struct(
                encoding=f"{number}", size=f"cast({n} AS int)", p_random=p_random, p_text=p_text
            )

        return let(f"cast(length({core}) AS double)", with_counts)

    def infer(core: Sql) -> Sql:
        arms = " ".join(
            f"WHEN {core} RLIKE {text_literal(pattern)} THEN {measured(core, i)}"
            for i, (_, pattern, _, _) in enumerate(ENCODINGS)
        )
        return f"CASE {arms} END"

    return let(f"rtrim('=', {token})", infer)


def _step(p: Sql) -> Sql:
    return (
        f"cast(least({MOST_STEPS}D, floor(-log10(greatest({p}, 1e-60D)) * {STEPS})) AS int)"
    )


def _tokens(text: Sql) -> Sql:
    """Random-looking tokens: ``struct<start, end, encoding, class, step, random>``."""

    def tested(hit: Sql) -> Sql:
        return let(
            _battery(f"{hit}.text"),
            lambda b: struct(
                start=f"{hit}.start",
                end=f"{hit}.end",
                encoding=f"{b}.encoding",
                **{"class": f"cast(floor(log2({b}.size)) AS int)"},
                step=_step(f"{b}.p_text"),
                random=f"{b}.p_random >= {BATTERY_LEVEL!r}D",
            ),
        )

    found = transform(_hits(text, TOKEN), tested)
    return keep(found, lambda t: f"{t}.encoding IS NOT NULL")


def _hits(text: Sql, pattern: str) -> Sql:
    """Hits with offsets; texts without one take a single look."""
    regex = text_literal(pattern)
    none = empty("array<struct<start:int,end:int,text:string>>")
    return f"CASE WHEN {text} RLIKE {regex} THEN {regex_hits(text, regex)} ELSE {none} END"


def discovery_steps(df: DataFrame, text: str = "text") -> dict[tuple[int, int], int]:
    """For each (encoding, length class) the least step of p-values that are
    discoveries, by Benjamini and Hochberg's rule over all tokens of ``df``.

    A step counts with its largest p-value, which errs towards fewer.  Tokens
    that fail the battery are tests too, but no discoveries.
    """
    body = f"coalesce(`{text}`, '')"
    rows = (
        df.select(F.expr(f"inline({_tokens(body)})"))
        .groupBy("encoding", "class", F.expr("if(random, step, -1)").alias("step"))
        .count()
        .collect()
    )
    classes: dict[tuple[int, int], dict[int, int]] = {}
    for r in rows:
        classes.setdefault((r["encoding"], r["class"]), {})[r["step"]] = r["count"]
    least = {}
    for name, counts in classes.items():
        tests, found = sum(counts.values()), 0
        for step in sorted((s for s in counts if s >= 0), reverse=True):
            found += counts[step]
            if 10 ** (-step / STEPS) <= FALSE_SHARE * found / tests:
                least[name] = step
    return least


# --- spans ----------------------------------------------------------------


def with_spans(
    df: DataFrame, steps: dict[tuple[int, int], int], text: str = "text"
) -> DataFrame:
    """``df`` with ``secret_spans``, all spans by start, kind and end."""
    body = f"coalesce(`{text}`, '')"

    def spans(hits: Sql, kind: str) -> Sql:
        number = KINDS.index(kind)
        return transform(
            hits, lambda h: struct(start=f"{h}.start", kind=str(number), end=f"{h}.end")
        )

    assign = keep(
        _hits(body, ASSIGN),
        lambda h: f"length(regexp_extract({h}.text, {text_literal(ASSIGN)}, 1)) >= {ASSIGN_LEAST}",
    )
    access = keep(_hits(body, ACCESS), lambda h: f"{h}.end - {h}.start >= {ACCESS_LEAST}")

    def discovered(token: Sql) -> Sql:
        arms = " ".join(
            f"WHEN {token}.encoding = {e} AND {token}.class = {c} THEN {token}.step >= {least}"
            for (e, c), least in sorted(steps.items())
        )
        return f"({token}.random AND CASE {arms} ELSE false END)" if arms else "false"

    random = keep(_tokens(body), discovered)
    kinds = [
        spans(assign, "assign"),
        spans(access, "access"),
        spans(_hits(body, HEX), "hex"),
        spans(random, "random"),
    ]
    return compute_once(df, secret_spans=f"array_sort({concat(kinds)})")


def _joined(spans: Sql) -> Sql:
    names = ", ".join(text_literal(k) for k in KINDS)
    each = transform(
        spans,
        lambda s: f"concat(element_at(array({names}), {s}.kind + 1), ':', {s}.start, ':', {s}.end)",
    )
    return f"array_join({each}, ',')"


def _count(kind: str) -> Sql:
    number = KINDS.index(kind)
    return f"cast(size({keep('secret_spans', lambda s: f'{s}.kind = {number}')}) AS bigint)"


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, the counts of the given patterns, the SHA-256 of their
    joined spans, and all spans joined."""
    base = keep("secret_spans", lambda s: f"{s}.kind != {KINDS.index('random')}")
    found = with_spans(df.select(key, text), discovery_steps(df, text), text)
    return found.select(
        key,
        F.expr(_count("assign")).alias("n_assign"),
        F.expr(_count("access")).alias("n_access"),
        F.expr(_count("hex")).alias("n_hex"),
        F.sha2(F.expr(_joined(base)), 256).alias("base_sha256"),
        F.expr(_joined("secret_spans")).alias("spans"),
        F.expr(_count("random")).alias("n_random"),
    )


def redact(df: DataFrame, text: str = "text", mark: str = MARK) -> DataFrame:
    """``df`` with every span (overlapping ones together) replaced by ``mark``;
    null texts stay null."""
    steps = discovery_steps(df, text)
    row = F.struct(*[F.col(f"`{name}`") for name in df.columns])  # no name can clash
    found = with_spans(df.select(row.alias("row")), steps, f"row`.`{text}")
    body = f"row.`{text}`"

    def cut(reach: Sql) -> Sql:
        """The gap before each span that begins a new cluster, and the mark."""

        def piece(span: Sql, i: Sql) -> Sql:
            return let(
                f"if({i} = 0, 0, get({reach}, {i} - 1))",
                lambda b: f"if({i} = 0 OR {span}.start >= {b}, concat(substr({body}, "
                f"{b} + 1, {span}.start - {b}), {text_literal(mark)}), '')",
            )

        pieces = transform("secret_spans", piece, arity=2)
        tail = f"substr({body}, get({reach}, size({reach}) - 1) + 1)"
        return f"concat(array_join({pieces}, ''), {tail})"

    ends = transform("secret_spans", lambda s: f"{s}.end")
    reach = running(ends, lambda a, b: f"greatest({a}, {b})", "0")
    clean = f"CASE WHEN size(secret_spans) > 0 THEN {let(reach, cut)} ELSE {body} END"
    return found.select(
        *[
            F.expr(clean).alias(name) if name == text else F.col(f"row.`{name}`")
            for name in df.columns
        ]
    )
