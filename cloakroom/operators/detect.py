"""Span detection: text column -> array of candidate entity structs.

Every detector is a pure Spark SQL expression over one text row (regex scans
plus higher-order array functions), so detection is a narrow, map-side
projection: no shuffle, no Python, and Catalyst can still prune columns and
push filters below it.

A candidate is ``struct<s, e, v, kind, tag, secret, custom, score, detector,
pri, ins, blen>``: character span ``[s, e)``, matched text ``v``, entity kind
and its placeholder tag, detector priority ``pri`` and an insertion ordinal
``ins`` (detector position, then pattern/term position) that reproduces the
stable tie order of the reconciliation sort; ``blen`` is the byte length of
``v``, the length the reconciliation ranks by.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakroom.functions import sqltext as Q
from cloakroom.operators.reconcile import reconcile_sql
from cloakroom.functions.text import ALNUM_CLASS, LOWER, UPPER, java_quote

CAND_TYPE = T.StructType(
    [
        T.StructField("s", T.IntegerType()),
        T.StructField("e", T.IntegerType()),
        T.StructField("v", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("secret", T.BooleanType()),
        T.StructField("custom", T.BooleanType()),
        T.StructField("score", T.FloatType()),
        T.StructField("detector", T.StringType()),
        T.StructField("pri", T.IntegerType()),
        T.StructField("ins", T.IntegerType()),
        T.StructField("blen", T.IntegerType()),
    ]
)
CANDS_TYPE = T.ArrayType(CAND_TYPE)

# --- fixed values that must equal the reference's for right results --------
# Placeholder tag of each built-in entity kind; a custom kind's tag is its name
# in ASCII upper case.
KIND_TAGS = {
    "person": "PERSON",
    "org": "ORG",
    "location": "LOC",
    "email": "EMAIL",
    "phone": "PHONE",
    "ssn": "SSN",
    "credit_card": "CARD",
    "ip_address": "IP",
    "iban": "IBAN",
    "file_path": "PATH",
    "secret": "SECRET",
}
# Built-in structured patterns in their fixed order (order breaks ties).
DEFAULT_PATTERNS = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "ssn"),
    (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", "credit_card"),
    (r"\b3[47]\d{2}[ -]?\d{6}[ -]?\d{5}\b", "credit_card"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", "ip_address"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "iban"),
    (r"\+?\d{1,4}(?:[ .\-]\d{3,4}){2,4}", "phone"),
]
# Detector priorities and scores.
GAZETTEER_PRIORITY, GAZETTEER_SCORE = 3, 1.0
DISCOVERED_PRIORITY = 2
EMAIL_PRIORITY, EMAIL_SCORE = 3, 0.95
REGEX_PRIORITY, REGEX_SCORE = 3, 0.9
ENTROPY_PRIORITY, ENTROPY_SCORE = 1, 0.6
ENTROPY_MIN_LEN, ENTROPY_MIN_BITS = 20, 3.5
# Characters of an e-mail local part / domain, and of an entropy token.
EMAIL_LOCAL_CLASS = r"[A-Za-z0-9._%+-]"
EMAIL_DOMAIN_CLASS = r"[A-Za-z0-9.-]"
TOKEN_CLASS = r"[A-Za-z0-9_+/=-]"
# Labels a semantic model may answer with, mapped to kinds; anything else is
# the custom kind "private".
MODEL_LABELS = {
    "person": "person",
    "name": "person",
    "people": "person",
    "org": "org",
    "organization": "org",
    "organisation": "org",
    "company": "org",
    "location": "location",
    "loc": "location",
    "place": "location",
    "address": "location",
    "gpe": "location",
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Kind:
    name: str
    tag: str
    secret: bool = False
    custom: bool = False


def kind_of(label: str) -> Kind:
    """Kind for a built-in kind name, else a custom kind named ``label``."""
    if label in KIND_TAGS:
        return Kind(label, KIND_TAGS[label], secret=label == "secret")
    tag = label.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    if "__" in tag or not tag:
        raise ValueError(f"custom kind {label!r} cannot form a placeholder tag")
    return Kind(label, tag, custom=True)


def _java_regex_ok(pattern: str) -> bool:
    """Compile a pattern with the JVM's regex engine (the one executors use)."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


BUILTIN_DIGIT_KINDS = {"ssn", "credit_card", "ip_address", "iban", "phone"}
CANDS_SQL = CANDS_TYPE.simpleString()
EMPTY_SQL = f"CAST(array() AS {CANDS_SQL})"


def _only_if(cond: str, arr: str) -> str:
    """``arr`` where ``cond`` holds, else an empty candidate array (CASE is lazy)."""
    return f"CASE WHEN {cond} THEN CAST({arr} AS {CANDS_SQL}) ELSE {EMPTY_SQL} END"


def _cand(s: str, v: str, kind: Kind, score: float, detector: str, pri: int, ins: int) -> str:
    return (
        f"named_struct('s', CAST({s} AS INT), 'e', CAST({s} + length({v}) AS INT), 'v', {v}, "
        f"'kind', {Q.lit(kind.name)}, 'tag', {Q.lit(kind.tag)}, 'secret', {str(kind.secret).lower()}, "
        f"'custom', {str(kind.custom).lower()}, 'score', CAST({score} AS FLOAT), 'detector', {Q.lit(detector)}, "
        f"'pri', {pri}, 'ins', {ins}, 'blen', CAST(octet_length({v}) AS INT))"
    )


def _to_cands(spans: str, kind: Kind, score: float, detector: str, pri: int, ins: int) -> str:
    m = Q.var("m")
    return f"transform({spans}, {m} -> {_cand(f'{m}.s', f'{m}.v', kind, score, detector, pri, ins)})"


def term_hits(t: str, term: str) -> str:
    """Word-bounded occurrences of ``term`` in SQL text ``t``: array<struct<s, v>>.

    One case-insensitive (ASCII) literal ``split``: occurrences are leftmost
    and non-overlapping, and since ASCII case folding keeps the length every
    occurrence is ``len(term)`` long, so the gaps alone give the offsets. An
    occurrence whose neighbours are letters/digits is dropped after the scan,
    having consumed its span like any other occurrence.
    """
    n = len(term)
    alnum = Q.lit(f"^{ALNUM_CLASS}$")

    def body(b):
        st, h = Q.var("st"), Q.var("h")
        left = f"({st} = 0 OR NOT coalesce(substring({t}, {st}, 1) RLIKE {alnum}, false))"
        right = f"NOT coalesce(substring({t}, {st} + {n + 1}, 1) RLIKE {alnum}, false)"
        hits = (
            f"transform({Q.starts(f'{b}.g', str(n))}, {st} -> named_struct('s', {st}, "
            f"'v', substring({t}, {st} + 1, {n}), 'ok', {left} AND {right}))"
        )
        return f"transform(filter({hits}, {h} -> {h}.ok), {h} -> named_struct('s', {h}.s, 'v', {h}.v))"

    return Q.let({"g": f"split({t}, {Q.lit('(?i)' + java_quote(term))}, -1)"}, body)


@dataclass
class Gazetteer:
    """Private-vocabulary terms: ``[(term, kind label)]`` (inline, small)."""

    terms: list[tuple[str, str]]
    priority: int = GAZETTEER_PRIORITY
    name: str = "gazetteer"

    def sql(self, t: str, base: int) -> list[str]:
        terms = [(j, term, label) for j, (term, label) in enumerate(self.terms) if term]
        if not terms:
            return []
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

        def body(b):
            parts = []
            for j, term, label in terms:
                found = _to_cands(term_hits(t, term), kind_of(label), GAZETTEER_SCORE, self.name, self.priority, base + j)
                # A plain substring test on the ASCII-lowercased text gates the scan.
                parts.append(_only_if(f"contains({b}.lo, {Q.lit(term.translate(lower))})", found))
            return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]

        return [Q.let({"lo": f"translate({t}, {Q.lit(UPPER)}, {Q.lit(LOWER)})"}, body)]

    def candidates(self, text: Column, base: int) -> list[Column]:
        return [F.expr(x) for x in self.sql(Q.name_of(text), base)]


@dataclass
class Email:
    """Addresses around each '@': maximal local run, domain run without trailing dots."""

    name: str = "email"
    priority: int = EMAIL_PRIORITY

    def sql(self, t: str, base: int) -> list[str]:
        # One match per '@': the whole local run before it (anchored at the run
        # start, possessive, so the scan stays linear) and, by lookahead, the
        # domain run after it — a domain may also be the next address's local part.
        pattern = f"(?<!{EMAIL_LOCAL_CLASS}){EMAIL_LOCAL_CLASS}*+@(?=({EMAIL_DOMAIN_CLASS}*))"
        spans = Q.regex_spans(t, pattern, groups=(1,))
        m, p = Q.var("m"), Q.var("p")
        parts = (
            f"transform({spans}, {m} -> named_struct('s', {m}.s, 'loc', substring({m}.v, 1, length({m}.v) - 1), "
            f"'dom', regexp_replace({m}.g1, {Q.lit(chr(92) + '.+' + chr(92) + 'z')}, '')))"
        )
        valid = (
            f"filter({parts}, {p} -> length({p}.loc) > 0 AND length({p}.dom) >= 3 "
            f"AND contains({p}.dom, '.') AND NOT startswith({p}.dom, '.'))"
        )
        q = Q.var("q")
        found = f"transform({valid}, {q} -> {_cand(f'{q}.s', f'concat({q}.loc, {chr(39)}@{chr(39)}, {q}.dom)', kind_of('email'), EMAIL_SCORE, self.name, self.priority, base)})"
        return [_only_if(f"contains({t}, '@')", found)]

    def candidates(self, text: Column, base: int) -> list[Column]:
        return [F.expr(x) for x in self.sql(Q.name_of(text), base)]


@dataclass
class RegexSet:
    """Structured patterns ``[(java-compatible regex, kind label)]``.

    Patterns run with ``(?U)`` so ``\\d``/``\\b`` are Unicode-aware; invalid
    patterns are skipped when the set is built (validated on the driver).
    """

    patterns: list[tuple[str, str]] = field(default_factory=lambda: list(DEFAULT_PATTERNS))
    name: str = "regex"
    priority: int = REGEX_PRIORITY

    def __post_init__(self):
        self.patterns = [(p, label) for p, label in self.patterns if _java_regex_ok("(?U)" + p)]

    def sql(self, t: str, base: int) -> list[str]:
        out = [
            _to_cands(Q.regex_spans(t, "(?U)" + p), kind_of(label), REGEX_SCORE, self.name, self.priority, base + j)
            for j, (p, label) in enumerate(self.patterns)
        ]
        # All built-in patterns need a digit; skip the scans for digit-free texts.
        if all(label in BUILTIN_DIGIT_KINDS for _, label in self.patterns):
            return [_only_if(f"{t} RLIKE {Q.lit('(?U)' + chr(92) + 'd')}", c) for c in out]
        return [f"CAST({c} AS {CANDS_SQL})" for c in out]

    def candidates(self, text: Column, base: int) -> list[Column]:
        return [F.expr(x) for x in self.sql(Q.name_of(text), base)]


@dataclass
class Entropy:
    """Maximal token runs at least ``min_len`` long with entropy >= ``min_bits``."""

    min_len: int = ENTROPY_MIN_LEN
    min_bits: float = ENTROPY_MIN_BITS
    name: str = "entropy"
    priority: int = ENTROPY_PRIORITY

    def sql(self, t: str, base: int) -> list[str]:
        spans = Q.regex_spans(t, f"(?<!{TOKEN_CLASS}){TOKEN_CLASS}{{{self.min_len},}}")
        m = Q.var("m")
        hot = f"filter({spans}, {m} -> {Q.entropy(f'{m}.v')} >= {self.min_bits})"
        return [f"CAST({_to_cands(hot, kind_of('secret'), ENTROPY_SCORE, self.name, self.priority, base)} AS {CANDS_SQL})"]

    def candidates(self, text: Column, base: int) -> list[Column]:
        return [F.expr(x) for x in self.sql(Q.name_of(text), base)]


# Ordinal range of one detector (terms / patterns of a detector are numbered inside it).
DETECTOR_ORDINAL_STRIDE = 100_000_000


@dataclass
class Profile:
    """An ordered detector ensemble; the order fixes the tie-break ordinal."""

    detectors: list
    harden: bool = False  # mask the uncovered rest of evicted secrets (Q6); off = parity

    def candidates_sql(self, t: str) -> str:
        parts: list[str] = []
        for i, d in enumerate(self.detectors):
            parts += d.sql(t, i * DETECTOR_ORDINAL_STRIDE)
        if not parts:
            return EMPTY_SQL
        return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]

    def candidates(self, text: Column) -> Column:
        return F.expr(self.candidates_sql(Q.name_of(text)))

    def detect(self, text: Column) -> Column:
        """Reconciled, non-overlapping, left-to-right entities of ``text``."""
        return F.expr(reconcile_sql(self.candidates_sql(Q.name_of(text)), self.harden))


def floor_profile(terms: list[tuple[str, str]] | None = None, discovered: list[tuple[str, str]] | None = None) -> Profile:
    """Vocabulary (if any) + e-mail + structured patterns + entropy (+ discovered terms)."""
    ds: list = []
    if terms:
        ds.append(Gazetteer(list(terms)))
    ds += [Email(), RegexSet(), Entropy()]
    if discovered:
        ds.append(Gazetteer(list(discovered), priority=DISCOVERED_PRIORITY))
    return Profile(ds)


def guard_profile(terms: list[tuple[str, str]] | None = None) -> Profile:
    """The precise identifier set: the floor without entropy and discovered terms."""
    ds: list = []
    if terms:
        ds.append(Gazetteer(list(terms)))
    ds += [Email(), RegexSet()]
    return Profile(ds)
