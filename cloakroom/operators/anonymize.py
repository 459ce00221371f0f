"""Outbound transform: detect -> intern -> splice placeholders.

Texts use the canonical layout ``session, ord, field_pos, text`` (one row per
text field; ``ord`` orders the texts of a session, ``field_pos`` the fields of
one text). Null sessions and places are keys like any other, and rows that share
a key are told apart by their text. Detection is map-side; the only shuffles are the distinct-original
aggregation and numbering (on entity rows, not text) and the join of the
per-text placeholder lists back to the texts (AQE broadcasts small lists).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakroom.functions.crypto import seal, unseal
from cloakroom.functions.joins import null_safe_join, row_key, sized
from cloakroom.functions.text import cut, explode_rows, let, pieces
from cloakroom.operators.detect import Profile
from cloakroom.operators.vault import degraded_placeholder, intern_durable, intern_session, protected
from cloakroom.session import materialize, stored

TEXT_KEYS = ["session", "ord", "field_pos"]


ROW_KEYS = [*TEXT_KEYS, "row"]


def detect_entities(texts: DataFrame, profile: Profile, text_col: str = "text", key: str | None = None) -> DataFrame:
    """Entity table E: one row per kept span (text keys, the row's own key, pos, candidate fields)."""
    keyed = texts.withColumn("row", row_key(F.col(text_col), key))
    rows = explode_rows(keyed, profile.detect(F.col(text_col)), ROW_KEYS, "pos", "_e")
    return rows.select(*ROW_KEYS, "pos", "_e.*")


def splice(text: Column, spans: Column) -> Column:
    """Replace sorted, non-overlapping spans ``struct<s, e, ph>`` in ``text``.

    Each piece is the gap before a span followed by its placeholder, cut from pieces of
    the text, so the result is built in one linear pass and joined once.
    """
    def spliced(b):
        def piece(x, i):
            prev = F.when(i == 0, F.lit(0)).otherwise(F.element_at(b["spans"], i)["e"])
            return F.concat(cut(b["pieces"], prev, x["s"] - prev), x["ph"])

        last = F.coalesce(F.try_element_at(b["spans"], F.lit(-1))["e"], F.lit(0))
        return F.concat(F.array_join(F.transform(b["spans"], piece), ""), cut(b["pieces"], last, F.length(text) - last))

    return let({"pieces": pieces(text), "spans": spans}, spliced)


@dataclass
class Anonymized:
    sanitized: DataFrame  # same rows as the input texts, text replaced
    audit: DataFrame  # one row per redaction, never the original
    vault: DataFrame  # session layer: SESSION_VAULT and ``original`` (unsealed when read)
    entities: DataFrame  # E with placeholders and ``v`` (unsealed when read: keep local)
    durable: DataFrame | None = None  # durable layer after this run
    durable_new: DataFrame | None = None  # its new rows, to be appended


def replace_spans(texts: DataFrame, with_ph: DataFrame, key: str | None = None) -> DataFrame:
    """``texts`` with the spans (row keys, s, e, placeholder) spliced in."""
    # a set: equal rows have found the same spans each
    spans = with_ph.groupBy(*ROW_KEYS).agg(
        F.array_sort(F.collect_set(F.struct("s", "e", F.col("placeholder").alias("ph")))).alias("_spans")
    )
    joined = null_safe_join(texts.withColumn("row", row_key(F.col("text"), key)), spans, ROW_KEYS, "left")
    return joined.withColumn(
        "text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("_spans")))
    ).drop("_spans", "row")


def audit_rows(with_ph: DataFrame) -> DataFrame:
    return with_ph.select(*TEXT_KEYS, "pos", "kind", "tag", "detector", "score")


def anonymize(texts: DataFrame, profile: Profile, durable: DataFrame | None = None, key: str | None = None, degraded: bool = False,
              attached: DataFrame | None = None) -> Anonymized:
    """Anonymize every text; one vault per session (plus an optional durable layer).

    With ``durable`` (a durable vault table, possibly empty) custom kinds are
    interned there and keep their placeholders across runs; everything else
    (e-mails, secrets, ...) is numbered per session. With ``key`` all that is
    written on the way holds keyed lookups and sealed originals alone. ``degraded``
    is for a run whose durable store can't be written: custom kinds get placeholders
    that nothing resolves. ``attached``: the same rows with what detectors need beside the
    text (``attach_terms``); they are looked at once and not passed on.
    """
    found = protected(detect_entities(texts if attached is None else attached, profile, key=key), key)
    # the ranks are of no use behind the detection; without a key the sealed original is the lookup's bytes
    ents = stored(found.drop("pri", "ins", "blen") if key else found.drop("pri", "ins", "blen", "sealed"))
    ents = ents if key else ents.withColumn("sealed", seal(F.col("lookup"), None))
    session_ents = ents if durable is None and not degraded else ents.where(~F.col("custom"))
    vault = materialize(intern_session(session_ents))
    with_ph = null_safe_join(session_ents, sized(vault.select("session", "tag", "lookup", "placeholder"), vault.count()), ["session", "tag", "lookup"])
    new = after = None
    if degraded:
        with_ph = with_ph.unionByName(ents.where("custom").withColumn("placeholder", degraded_placeholder(F.col("tag"), F.col("lookup"))))
    elif durable is not None:
        custom = ents.where("custom")
        new = materialize(intern_durable(custom, durable))
        after = durable.unionByName(new)
        with_ph = with_ph.unionByName(custom.join(sized(after.select("tag", "lookup", "placeholder"), after.count()), ["tag", "lookup"]))
    return Anonymized(
        sanitized=replace_spans(texts, with_ph, key),
        audit=audit_rows(with_ph),
        vault=vault.withColumn("original", unseal(F.col("sealed"), key)),
        entities=with_ph.withColumn("v", unseal(F.col("sealed"), key)),
        durable=after,
        durable_new=new,
    )
