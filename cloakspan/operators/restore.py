"""Restoration: placeholders in any text go back to the originals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import (
    Sql,
    compute_once,
    empty,
    exists,
    fold,
    let,
    struct,
    text_literal,
    transform,
)
from ..functions.joins import join_unique
from ..functions.placeholders import placeholder_regex
from ..functions.spans import regex_hits, splice
from ..functions.staging import stage
from ..functions.windows import windows
from .crypto import Keyring
from .mapping import restorations
from .occurrences import occurrences
from .redact import join_edits

UNIT = ["scope_id", "doc_id", "unit_no"]


EDIT = "struct<start:int,end:int,placeholder:string>"


def placeholder_hits(parts: Sql) -> Sql:
    """Everything in a text, given by its windows, that looks like a generated
    placeholder, with offsets."""

    def search(w: Sql) -> Sql:
        return transform(
            regex_hits(f"{w}.body", text_literal(placeholder_regex())),
            lambda h: struct(start=f"{w}.at + {h}.start", end=f"{w}.at + {h}.end", text=f"{h}.text"),
        )

    return f"flatten({transform(parts, search)})"


def _custom(known: DataFrame) -> DataFrame:
    """Placeholders of a mapping that no template or list gives."""
    generated = text_literal(rf"\A(?:{placeholder_regex()})\z")
    return known.where(f"placeholder != '' AND NOT placeholder RLIKE {generated}").select(
        "scope_id", "placeholder"
    )


def _custom_hits(units: DataFrame, custom: DataFrame) -> DataFrame:
    """Where the custom placeholders of its scope stand in a unit."""
    values = custom.select("scope_id", F.col("placeholder").alias("value"))
    found = occurrences(units, values, [], on=["scope_id"], case_blind=False)
    return found.select(
        *UNIT, "start", F.expr("start + length(text)").alias("end"), F.col("text").alias("placeholder")
    )


def _apart(edits: Sql) -> Sql:
    """Edits by start; of those that overlap the longest, then the first, stay."""

    def choose(ordered: Sql) -> Sql:
        ranked = transform(
            ordered,
            lambda e: struct(k0=f"{e}.start - {e}.end", k1=f"{e}.start", edit=e),
        )

        def step(kept: Sql, item: Sql) -> Sql:
            clash = exists(
                kept,
                lambda k: f"({item}.edit.end > {k}.start AND {item}.edit.start < {k}.end)",
            )
            return f"if({clash}, {kept}, concat({kept}, array({item}.edit)))"

        touching = exists(
            f"sequence(1, greatest(size({ordered}) - 1, 1))",
            lambda i: f"coalesce(get({ordered}, {i}).start < get({ordered}, {i} - 1).end, false)",
        )
        greedy = fold(f"array_sort({ranked})", empty(f"array<{EDIT}>"), step)
        return f"CASE WHEN {touching} THEN array_sort({greedy}) ELSE {ordered} END"

    return let(f"array_sort({edits})", choose)


def restore_units(
    units: DataFrame, mapping: DataFrame, keyring: Keyring | None = None
) -> DataFrame:
    """Restore in one pass: find candidates, look them up by (scope,
    placeholder), put the originals in.

    Every placeholder that the mapping holds is found: generated ones by their
    pattern, custom ones by a join.  Restored text is never searched again, and
    a longer placeholder is never taken for a shorter one.  Adds ``restored``
    and ``restorations``.  With a ``keyring`` the mapping is sealed, and only
    joined rows are decrypted.  The units are read once and staged with their
    candidates.
    """
    value = "original" if keyring is None else "original_enc"
    known = stage(restorations(mapping, value), "restorations")
    columns = units.columns
    worked = compute_once(units, _windows=windows("text"))
    worked = compute_once(worked, _hits=placeholder_hits("_windows")).drop("_windows")
    units = stage(worked, "candidates")
    candidates = units.select(
        *UNIT, F.expr("inline(_hits)").alias("start", "end", "placeholder")
    )
    custom = _custom(known)
    has_custom = not custom.isEmpty()
    if has_custom:
        # read twice below, and dear: every place of the texts is looked at
        candidates = candidates.unionByName(stage(_custom_hits(units, custom), "custom-hits"))
    found = join_unique(
        candidates, known, ["scope_id", "placeholder"], ["doc_id", "unit_no", "start"]
    )
    if keyring is not None:
        opened = keyring.decrypt(F.col("original_enc"))
        found = found.withColumn(
            "original",
            F.coalesce(
                opened,
                F.raise_error(F.lit("cannot decrypt: wrong password")).cast("string"),
            ),
        )
    edits = found.groupBy(*UNIT).agg(
        F.collect_list(
            F.struct("start", "end", F.col("original").alias("placeholder"))
        ).alias("edits")
    )
    if has_custom:
        edits = edits.withColumn("edits", F.expr(_apart("edits")))
    else:
        edits = edits.withColumn("edits", F.array_sort("edits"))
    gate = None if has_custom else "size(_hits) > 0"
    changed = struct(text=splice("text", "edits"), hits="cast(size(edits) AS bigint)")
    done = join_edits(units, edits, changed, "_out", gate, struct(text="text", hits="0L"))
    return done.select(
        *columns,
        F.col("_out.text").alias("restored"),
        F.col("_out.hits").alias("restorations"),
    )


def scope_restorations(mapping: DataFrame) -> DataFrame:
    """Per scope the placeholders in creation order with their last original.

    For the sequential mode only: a scope here is a document or a session.
    """
    last = restorations(mapping)
    order = [c for c in ("doc_ord", "unit_no", "pos") if c in mapping.columns]
    first = mapping.groupBy("scope_id", "placeholder").agg(
        F.min(F.struct(*order, "pii_type", "n")).alias("made")
    )
    return (
        last.join(first, ["scope_id", "placeholder"])
        .groupBy("scope_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("made", "placeholder", "original"))
            ).alias("pairs")
        )
    )


def restore_sequential(text: Sql, pairs: Sql) -> Sql:
    """Replace one placeholder after the other on the changing text.

    Struct of ``text`` and ``hits``; the compatibility mode, in which
    ``@user1`` also rewrites the head of ``@user10``.
    """

    def step(acc: Sql, pair: Sql) -> Sql:
        gone = f"length(replace({acc}.text, {pair}.placeholder, ''))"
        hits = f"(length({acc}.text) - {gone}) div length({pair}.placeholder)"
        swapped = struct(
            text=f"replace({acc}.text, {pair}.placeholder, {pair}.original)",
            hits=f"{acc}.hits + {hits}",
        )
        return f"if(contains({acc}.text, {pair}.placeholder), {swapped}, {acc})"

    return fold(pairs, struct(text=text, hits="0L"), step)


def restore_units_sequential(units: DataFrame, mapping: DataFrame) -> DataFrame:
    """The compatibility mode over units; scopes without mapping stay as is."""
    joined = units.join(scope_restorations(mapping), "scope_id", "left")
    unchanged = struct(text="text", hits="0L")
    out = f"if(pairs IS NULL, {unchanged}, {restore_sequential('text', 'pairs')})"
    return compute_once(joined, _out=out).select(
        *units.columns,
        F.col("_out.text").alias("restored"),
        F.col("_out.hits").alias("restorations"),
    )


def split_unknown_scopes(
    units: DataFrame, mapping: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Units whose scope has a mapping, and an error row per other unit."""
    scopes = mapping.select("scope_id").distinct()
    known = units.join(scopes, "scope_id", "left_semi")
    unknown = units.join(scopes, "scope_id", "left_anti").select(
        *UNIT, F.lit("no mappings available for restoration").alias("error")
    )
    return known, unknown


def restore_strict(units: DataFrame, mapping: DataFrame, **options) -> DataFrame:
    """As :func:`restore_units`, but a scope without mapping is an error."""
    scopes = mapping.select("scope_id").distinct().withColumn("_known", F.lit(True))
    checked = units.join(scopes, "scope_id", "left").withColumn(
        "text",
        F.when(F.col("_known"), F.col("text")).otherwise(
            F.raise_error(F.lit("no mappings available for restoration")).cast("string")
        ),
    )
    return restore_units(checked.drop("_known"), mapping, **options)
