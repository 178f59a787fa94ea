"""SQL for spans of a pattern in a text, in time linear in the text and its matches."""

from __future__ import annotations

#: Elements that are summed one by one; sums of whole blocks of as many are kept.
_BLOCK = 128


def literal(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def running(values: str, zero: str, merge: str) -> str:
    """SQL: for each element of an array of ints what {0} and {1} of ``merge`` make of it and all before it.

    Each element is merged with those before it in its block and with what the blocks before amount to,
    so no step copies a list that grows with the array.
    """
    fold = lambda some: f"aggregate({some}, {zero}, (a, x) -> {merge.format('a', 'x')})"
    totals = f"transform(sequence(0, (size(v) - 1) div {_BLOCK}), k -> {fold(f'slice(v, cast(k * {_BLOCK} + 1 as int), {_BLOCK})')})"
    before = f"transform(array({totals}), t -> transform(t, (y, k) -> {fold('slice(t, 1, k)')}))[0]"
    own = fold(f"slice(v, cast(i - i % {_BLOCK} + 1 as int), cast(i % {_BLOCK} + 1 as int))")
    each = f"transform(v, (y, i) -> {merge.format(f'b[cast(i div {_BLOCK} as int)]', own)})"
    return f"transform(array({values}), v -> case when size(v) = 0 then v else transform(array({before}), b -> {each})[0] end)[0]"


def matches(text: str, pattern: str, reach: int) -> str:
    """SQL: start, end, s, before and after of each match, in code points, the end exclusive.

    ``before`` is the end, of at most ``reach`` characters, of what stands between the match and the one
    before; ``after`` is the next character, empty at the text's end.
    """
    p = literal(pattern)
    sizes = "zip_with(slice(x.g, 1, size(x.m)), x.m, (g, m) -> length(g) + length(m))"
    after = "case when x.g[i + 1] <> '' then substring(x.g[i + 1], 1, 1) when i + 1 < size(x.m) then substring(x.m[i + 1], 1, 1) else '' end"
    found = f"transform(x.m, (m, i) -> named_struct('start', e[i] - length(m), 'end', e[i], 's', m, 'before', right(x.g[i], {reach}), 'after', {after}))"
    return f"transform(array(named_struct('g', split({text}, {p}, -1), 'm', regexp_extract_all({text}, {p}, 0))), x -> transform(array({running(sizes, '0', '{0} + {1}')}), e -> {found})[0])[0]"


def apart(spans: str, others: str) -> str:
    """SQL: the spans that overlap none of the others; both are arrays of one type with start and end, the
    others in order of their starts."""
    tagged = lambda c, k: f"transform({c}, s -> named_struct('start', s.start, 'other', {k}, 'span', s))"
    merged = f"array_sort(concat({tagged(others, 0)}, {tagged(spans, 1)}))"
    ends = running("transform(w, s -> if(s.other = 0, s.span.end, 0))", "0", "greatest({0}, {1})")
    most = (1 << 31) - 1
    starts = running(f"reverse(transform(w, s -> if(s.other = 0, s.start, {most})))", f"{most}", "least({0}, {1})")
    keep = "filter(transform(w, (s, j) -> named_struct('span', s.span, 'ok', s.other = 1 and ends[j] <= s.start and starts[cast(size(w) - 1 - j as int)] >= s.span.end)), s -> s.ok)"
    return f"case when size({spans}) = 0 or size({others}) = 0 then {spans} else transform(array({merged}), w -> transform(array({ends}), ends -> transform(array({starts}), starts -> transform({keep}, s -> s.span))[0])[0])[0] end"
