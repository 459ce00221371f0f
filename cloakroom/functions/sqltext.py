"""Building Spark SQL expression text (parsed once in the JVM by ``F.expr``).

Detection expressions are large trees of higher-order functions; composing
them as SQL text costs one parser call instead of thousands of py4j calls.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column

_ids = itertools.count()


def var(prefix: str = "v") -> str:
    """A fresh lambda variable name (nested lambdas must not shadow each other)."""
    return f"{prefix}_{next(_ids)}"


def lit(s: str) -> str:
    """A SQL string literal for ``s`` (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_of(c: Column | str) -> str:
    """SQL text for a plain column reference."""
    name = c if isinstance(c, str) else c._jc.toString()
    return "`" + name.replace("`", "``") + "`"


def let(bindings: dict[str, str], body) -> str:
    """Evaluate each binding once; ``body(b)`` reads them as ``{b}.name``."""
    b = var("b")
    fields = ", ".join(f"{lit(k)}, {v}" for k, v in bindings.items())
    return f"element_at(transform(array(named_struct({fields})), {b} -> {body(b)}), 1)"


#: Characters of the pieces that a text is cut into where many places of it are read.
PIECE = 256


def starts(gaps: str, width: str) -> str:
    """Offsets of equally wide matches from the pieces between them (one running fold)."""
    a, x = var("a"), var("x")
    zero = "named_struct('p', 0, 'a', CAST(array() AS array<int>))"
    step = f"named_struct('p', {a}.p + length({x}) + {width}, 'a', concat({a}.a, array({a}.p + length({x}))))"
    return f"aggregate(slice({gaps}, 1, size({gaps}) - 1), {zero}, ({a}, {x}) -> {step}, {a} -> {a}.a)"


#: Numbers that one fold of ``running`` sums (a fold copies its array at each step), and how often blocks are made of blocks.
_FOLD, _LEVELS = 16, 2


def running(xs: str, levels: int = _LEVELS) -> str:
    """Running sums of an int array: folds over blocks, moved on by the sums of the blocks before (running sums themselves)."""
    k, a, x, q, z, i, v = var("k"), var("a"), var("x"), var("q"), var("z"), var("i"), var("v")
    none = "CAST(array() AS array<int>)"
    inner = f"named_struct('p', {a}.p + {x}, 'a', concat({a}.a, array({a}.p + {x})))"

    def fold(ys):
        return f"aggregate({ys}, named_struct('p', 0, 'a', {none}), ({a}, {x}) -> {inner}, {a} -> {a}.a)"

    def blocks(b):
        cut = f"transform(sequence(0, greatest(size({b}.xs) - 1, 0) div {_FOLD}), {k} -> slice({b}.xs, CAST({k} * {_FOLD} + 1 AS INT), {_FOLD}))"
        return f"transform({cut}, {q} -> {fold(q)})"

    def moved(b):
        ends = running(f"transform({b}.q, {q} -> coalesce(try_element_at({q}, -1), 0))", levels - 1)

        def added(c):
            # what the blocks before block {i} come to
            before = f"CASE WHEN {i} = 0 THEN 0 ELSE {c}.ends[{i} - 1] END"
            return f"flatten(transform({b}.q, ({x}, {i}) -> {let({'x': x, 'z': before}, lambda d: f'transform({d}.x, {v} -> {v} + {d}.z)')}))"

        return f"CASE WHEN size({b}.q) = 1 THEN {b}.q[0] ELSE {let({'ends': ends}, added)} END"

    return let({"xs": xs}, lambda b: let({"q": blocks(b)}, moved)) if levels else fold(xs)


def pieces(t: str) -> str:
    """A text as pieces of equal length, for ``cut``."""
    return f"regexp_extract_all({t}, {lit(f'(?s).{{1,{PIECE}}}')}, 0)"


def cut(parts: str, at: str, n: str) -> str:
    """``n`` characters of a text behind ``at``, of the ``pieces`` that hold them (``substring`` counts from the text's beginning)."""
    size = f"CAST(({at} + {n}) div {PIECE} - {at} div {PIECE} + 1 AS INT)"
    return f"substring(array_join(slice({parts}, CAST({at} div {PIECE} + 1 AS INT), {size}), ''), {at} % {PIECE} + 1, {n})"


# Noncharacters that mark a match, its groups and its end; a text's own are taken for U+FDD3.
_MATCH, _GROUP, _END, _OWN = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def regex_spans(t: str, pattern: str, groups: tuple[int, ...] = ()) -> str:
    """array<struct<s, v, g1..>> of leftmost non-overlapping, non-empty matches with 0-based char offsets.

    The pattern is scanned once: every match is marked in place, and a running fold
    over the marked pieces gives the offsets (empty matches advance nothing).
    """
    shown = _MATCH + "$0" + "".join(f"{_GROUP}${g}" for g in groups) + _END
    clean = f"CASE WHEN {t} RLIKE {lit(f'[{_MATCH}-{_END}]')} THEN translate({t}, {lit(_MATCH + _GROUP + _END)}, {lit(_OWN * 3)}) ELSE {t} END"
    a, x, y = var("a"), var("x"), var("y")

    def body(b):
        names = ["v", *[f"g{k}" for k in range(1, len(groups) + 1)]]
        fields = ", ".join(f"{lit(n)}, {y}.f[{k}]" for k, n in enumerate(names))
        found = f"named_struct('s', {a}.p, {fields})"
        kind = "array<struct<s: int, " + ", ".join(f"{n}: string" for n in names) + ">>"
        head = f"substring_index({x}, {lit(_END)}, 1)"
        items = f"transform(slice({b}.m, 2, size({b}.m)), {x} -> named_struct('f', split({head}, {lit(_GROUP)}, -1), 'rest', length({x}) - length({head}) - 1))"
        step = f"named_struct('p', {a}.p + length({y}.f[0]) + {y}.rest, 'a', CASE WHEN length({y}.f[0]) = 0 THEN {a}.a ELSE concat({a}.a, array({found})) END)"
        zero = f"named_struct('p', length({b}.m[0]), 'a', CAST(array() AS {kind}))"
        return f"aggregate({items}, {zero}, ({a}, {y}) -> {step}, {a} -> {a}.a)"

    return let({"m": f"split(regexp_replace({clean}, {lit(pattern)}, {lit(shown)}), {lit(_MATCH)}, -1)"}, body)


def entropy(w: str) -> str:
    """Shannon entropy (bits per char) of an ASCII token, distinct chars ascending."""
    h, c = var("h"), var("c")
    cnt = f"(length({w}) - length(replace({w}, {c}, '')))"
    return (
        f"aggregate(array_sort(array_distinct(split({w}, ''))), CAST(0 AS DOUBLE), "
        f"({h}, {c}) -> {h} - ({cnt} / length({w})) * log2({cnt} / length({w})))"
    )
