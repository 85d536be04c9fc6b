"""Likeness of two texts, as SQL expressions that stay inside the JVM, but for ``lcs``, a helper for one row.

Each other function takes names of columns and gives an expression; texts are split at white space.
"""

from __future__ import annotations

import re


def tokens(x: str) -> str:
    return rf"split({x}, '\\s+')"


def lcs(a: list[str] | None, b: list[str] | None) -> int | None:
    """Length of the longest common subsequence of two lists, a row of the usual table in the bits of one number."""
    if a is None or b is None:
        return None
    at: dict[str, int] = {}
    for i, t in enumerate(a):
        at[t] = at.get(t, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every  # a zero for each place where the length grows
    for t in b:
        if t in at:
            met = row & at[t]
            row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def token_lcs(x: str, y: str, common: str | None = None) -> str:
    """Longest common subsequence of the tokens, over their mean number.

    ``common``: a column that has its length by ``lcs``, as texts of any length need; without it rows of the usual table, one token of ``x`` each.
    """
    row = "aggregate(sequence(1, size(b)), array(0), (new, j) -> concat(new, array(if(t = b[j - 1], old[j - 1] + 1, greatest(old[j], new[j - 1])))))"
    table = f"aggregate(a, array_repeat(0, size(b) + 1), (old, t) -> {row}, last -> element_at(last, -1))"
    body = f"{common or table} * 2e0 / (size(a) + size(b))"
    return _with(body, x, y)


def characters(x: str, y: str) -> str:
    """One less the edit distance over the longer length; two empty texts are equal."""
    return f"if(greatest(length({x}), length({y})) = 0, 1e0, 1e0 - levenshtein({x}, {y}) / greatest(length({x}), length({y})))"


def jaccard(x: str, y: str) -> str:
    body = "if(size(array_union(a, b)) = 0, 1e0, size(array_intersect(a, b)) * 1e0 / size(array_union(a, b)))"
    return _with(body, f"trim({x})", f"trim({y})", "filter({}, w -> w <> '')")


def light(x: str, y: str) -> str:
    """Shared tokens, or six tenths of them and four of the tokens met in lock-step; equal texts 1, an empty one 0."""
    met = "if(array_contains(a, b[0]), aggregate(a, 0, (j, t) -> if(j < size(b) and t = b[j], j + 1, j)), 0)"
    counts = "array(struct(size(array_intersect(a, b)) as i, size(array_union(a, b)) as u))"
    one = f"transform({counts}, s -> greatest(s.i * 1e0 / s.u, 0.6e0 * s.i * 1e0 / s.u + 0.4e0 * {met} / greatest(size(a), size(b))))[0]"
    body = f"if(size(a) = 0 or size(b) = 0, if(size(a) = size(b), 1e0, 0e0), {one})"
    return f"case when {x} = '' or {y} = '' then 0e0 when {x} = {y} then 1e0 else {_with(body, x, y, 'filter({}, w -> w <> ' + chr(39) * 2 + ')')} end"


def fuzzy(x: str, y: str) -> str:
    """Every token of ``x`` takes the free token of ``y`` most like it, the first of equals, if over 0.7 alike; their sum over the longer number."""
    alike = f"case when t = u then 1e0 when least(length(t), length(u)) > 2 then {characters('t', 'u')} else 0e0 end"
    free = f"transform(b, (u, i) -> struct(if(array_contains(s.used, i), 0e0, {alike}) as score, -i as at))"
    step = f"transform(array(array_max({free})), m -> if(m.score > 0.7e0, struct(concat(s.used, array(-m.at)) as used, s.total + m.score as total), s))[0]"
    total = f"aggregate(a, struct(array(cast(null as int)) as used, 0e0 as total), (s, t) -> {step}, s -> s.total)"
    total = total.replace("array_contains(s.used, i)", "coalesce(array_contains(s.used, i), false)")
    body = f"{total} / greatest(size(a), size(b))"
    return f"case when {x} = '' or {y} = '' then 0e0 when {x} = {y} then 1e0 else {_with(body, x, y)} end"


def advanced(x: str, y: str, common: str | None = None) -> str:
    """Token order, edit distance, shared tokens and fuzzy tokens, weighted by mean length: under 20, under 60, and from there."""
    t, c, j, f = token_lcs(x, y, common), characters(x, y), jaccard(x, y), fuzzy(x, y)
    mean = f"(length({x}) + length({y})) / 2e0"
    body = f"""case when m < 20 then greatest(c * 0.4e0 + t * 0.3e0 + j * 0.2e0 + f * 0.1e0, c, t)
        when m < 60 then greatest(t * 0.4e0 + c * 0.3e0 + j * 0.2e0 + f * 0.1e0, t, c) else greatest(t * 0.5e0 + j * 0.3e0 + c * 0.1e0 + f * 0.1e0, t) end"""
    for name in "tcjfm":
        body = re.sub(rf"\b{name}\b", f"v.{name}", body)
    parts = f"struct({t} as t, {c} as c, {j} as j, {f} as f, {mean} as m)"
    return f"case when {x} = '' or {y} = '' then 0e0 when {x} = {y} then 1e0 else transform(array({parts}), v -> {body})[0] end"


def _with(body: str, x: str, y: str, shape: str = "{}") -> str:
    """``body`` over the token arrays ``a`` and ``b``."""
    for name, text in (("a", x), ("b", y)):
        body = re.sub(rf"(?<![\w.]){name}(?![\w(])", f"p.{name}", body)
    a, b = (shape.format(tokens(t)) for t in (x, y))
    return f"transform(array(struct({a} as a, {b} as b)), p -> {body})[0]"
