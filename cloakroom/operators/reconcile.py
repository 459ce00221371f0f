"""Overlap reconciliation of candidate spans, inside one row.

Rank candidates by priority (high first), byte length (long first), score
(high first), start (early first) and finally the insertion ordinal; walk the
ranking and keep every candidate that overlaps nothing kept so far; return the
kept spans left to right. One sweep by start with the largest end so far cuts the
candidates into components that overlap nothing of each other; the ranking is
walked inside each, so a text with very many spans costs little more than sorting
them. It all runs on the candidate array of the row and needs no shuffle. Arrays
are bound once (``let``) so the candidate expression is not evaluated per reference.
"""

from __future__ import annotations

from cloakroom.functions import sqltext as Q


#: Spans of one fold over a text's spans.
_BLOCK = 64


def harden_sql(ranked: str, kept: str) -> str:
    """Kept spans plus, for every dropped secret candidate, its stretches not
    covered by a kept span, as new SECRET spans (off by default: parity keeps
    the rest of an evicted secret in clear)."""
    d, k, o, x, y, p = (Q.var(n) for n in ("d", "k", "o", "x", "y", "p"))
    dropped = (
        f"filter({ranked}, {d} -> {d}.secret AND NOT exists({kept}, {k} -> {k}.s = {d}.s AND {k}.e = {d}.e AND {k}.ins = {d}.ins))"
    )
    cover = (
        f"array_sort(filter({kept}, {o} -> {o}.s < {d}.e AND {d}.s < {o}.e), "
        f"({x}, {y}) -> CASE WHEN {x}.s < {y}.s THEN -1 WHEN {x}.s > {y}.s THEN 1 ELSE 0 END)"
    )
    starts = f"concat(array({d}.s), transform({cover}, {o} -> {o}.e))"
    ends = f"concat(transform({cover}, {o} -> {o}.s), array({d}.e))"
    gaps = (
        f"filter(zip_with({starts}, {ends}, ({x}, {y}) -> named_struct('a', greatest({x}, {d}.s), 'b', least({y}, {d}.e))), "
        f"{p} -> {p}.b > {p}.a)"
    )
    v = f"substring({d}.v, {p}.a - {d}.s + 1, {p}.b - {p}.a)"
    piece = (
        f"named_struct('s', CAST({p}.a AS INT), 'e', CAST({p}.b AS INT), 'v', {v}, "
        f"'kind', {d}.kind, 'tag', {d}.tag, 'secret', true, 'custom', false, 'score', {d}.score, "
        f"'detector', {d}.detector, 'pri', {d}.pri, 'ins', {d}.ins, 'blen', CAST(octet_length({v}) AS INT))"
    )
    rest = f"flatten(transform({dropped}, {d} -> transform({gaps}, {p} -> {piece})))"
    return f"concat({kept}, {rest})"


def reconcile_sql(cands: str, harden: bool = False) -> str:
    """Rank (priority, byte length, score desc; start, ordinal asc), keep greedily, sort by start."""
    l, r = Q.var("l"), Q.var("r")
    order = (
        f"({l}, {r}) -> CASE WHEN {l}.pri > {r}.pri THEN -1 WHEN {l}.pri < {r}.pri THEN 1 "
        f"WHEN {l}.blen > {r}.blen THEN -1 WHEN {l}.blen < {r}.blen THEN 1 "
        f"WHEN {l}.score > {r}.score THEN -1 WHEN {l}.score < {r}.score THEN 1 "
        f"WHEN {l}.s < {r}.s THEN -1 WHEN {l}.s > {r}.s THEN 1 "
        f"WHEN {l}.ins < {r}.ins THEN -1 WHEN {l}.ins > {r}.ins THEN 1 ELSE 0 END"
    )

    def settled(part):
        """The spans kept of one component, left to right."""
        acc, x, k = Q.var("acc"), Q.var("x"), Q.var("k")

        def greedy(b):
            return (
                f"aggregate({b}.r, slice({b}.r, 1, 0), ({acc}, {x}) -> CASE WHEN exists({acc}, {k} -> {x}.s < {k}.e AND {k}.s < {x}.e) "
                f"THEN {acc} ELSE concat({acc}, array({x})) END)"
            )

        kept = Q.let({"r": f"array_sort({part}, {order})"}, (lambda b: harden_sql(f"{b}.r", greedy(b))) if harden else greedy)
        return f"CASE WHEN size({part}) = 1 THEN {part} ELSE array_sort({kept}, {_by_start()}) END"

    acc, x, y, at, j, q, k, i = (Q.var(n) for n in ("acc", "x", "y", "at", "j", "q", "k", "i"))
    # where components begin: at a span that starts behind all ends so far; a fold copies what it holds
    # at each step, so it goes block by block
    none = "CAST(array() AS array<int>)"
    step = f"named_struct('end', greatest({acc}.end, {x}.e), 'cuts', CASE WHEN {x}.s >= {acc}.end THEN concat({acc}.cuts, array({x}.i)) ELSE {acc}.cuts END)"

    def cuts(b):
        places = f"transform({b}.spans, ({x}, {i}) -> named_struct('s', {x}.s, 'e', {x}.e, 'i', {i} + 1))"

        def blocks(c):
            cut = f"transform(sequence(0, greatest(size({c}.places) - 1, 0) div {_BLOCK}), {k} -> slice({c}.places, CAST({k} * {_BLOCK} + 1 AS INT), {_BLOCK}))"
            inner = f"aggregate({q}, named_struct('end', {y}.end, 'cuts', {none}), ({acc}, {x}) -> {step})"
            outer = Q.let({"r": inner}, lambda d: f"named_struct('end', {d}.r.end, 'cuts', concat({y}.cuts, array({d}.r.cuts)))")
            return f"aggregate({cut}, named_struct('end', -1, 'cuts', array({none})), ({y}, {q}) -> {outer}, {y} -> flatten({y}.cuts))"

        return Q.let({"places": places}, blocks)

    def components(b):
        def parts(c):
            size = f"coalesce(try_element_at({c}.cuts, {j} + 2), size({b}.spans) + 1) - {at}"
            return f"flatten(transform({c}.cuts, ({at}, {j}) -> {Q.let({'part': f'slice({b}.spans, {at}, {size})'}, lambda d: settled(f'{d}.part'))}))"

        behind = f"slice({b}.spans, 2, size({b}.spans)), slice({b}.spans, 1, greatest(size({b}.spans) - 1, 0))"
        apart = f"NOT exists(zip_with({behind}, ({x}, {y}) -> {x}.s < {y}.e), {q} -> {q})"
        # spans that all end before the next one starts stay as they are
        return f"CASE WHEN {apart} THEN {b}.spans ELSE {Q.let({'cuts': cuts(b)}, parts)} END"

    return Q.let({"spans": f"array_sort({cands}, {_by_start()})"}, components)


def _by_start() -> str:
    l, r = Q.var("l"), Q.var("r")
    return f"({l}, {r}) -> CASE WHEN {l}.s < {r}.s THEN -1 WHEN {l}.s > {r}.s THEN 1 ELSE 0 END"
