"""SQL for spans of a text that stay in arrays, in time close to linear in their number.

Spark's arrays can't grow, so a running sum that appends to one copies it each time. Here sums run in blocks of BLOCK,
and an overlap is looked for among blocks of blocks of spans, each with the range that it covers.
"""

from __future__ import annotations

BLOCK = 64
SPAN = "array<struct<s:int,e:int,v:string>>"


def let(name: str, value: str, body: str) -> str:
    """body with `name` for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def places(text: str, pattern: str, measure: str = "length({})") -> str:
    """(s, e, v) of the matches of a pattern: offsets, ends exclusive, in what `measure` counts, and the matches.

    text, pattern: SQL expressions. measure must add up: that of two strings in a row is the sum of both.
    """
    size = lambda x: f"{measure.format(f'{x}.g')} + {measure.format(f'{x}.v')}"
    each = f"zip_with(slice(split({text}, {pattern}, -1), 1, size(found_)), found_, (g, v) -> struct(g AS g, v AS v))"
    blocks = f"transform(sequence(0, (size(each_) - 1) div {BLOCK}), i -> slice(each_, i * {BLOCK} + 1, {BLOCK}))"
    firsts = f"aggregate(blocks_, array(0), (acc, b) -> concat(acc, array(element_at(acc, -1) + aggregate(b, 0, (n, x) -> n + int({size('x')})))))"
    span = f"struct(int(acc.at + {measure.format('x.g')}) AS s, int(acc.at + {size('x')}) AS e, x.v AS v)"
    inside = f"aggregate(b, struct(first AS at, CAST(array() AS {SPAN}) AS out), (acc, x) -> struct(int(acc.at + {size('x')}) AS at, concat(acc.out, array({span})) AS out), acc -> acc.out)"
    spans = f"flatten(zip_with(blocks_, slice(firsts_, 1, size(blocks_)), (b, first) -> {inside}))"
    some = let("each_", each, let("blocks_", blocks, let("firsts_", firsts, spans)))
    return let("found_", f"regexp_extract_all({text}, {pattern}, 0)", f"if(size(found_) = 0, CAST(array() AS {SPAN}), {some})")


def _grouped(array: str, low: str, high: str) -> str:
    ends = lambda f, pick: f"array_{pick}(transform(items, x -> x.{f}))"
    block = let("items", f"slice({array}, i * {BLOCK} + 1, {BLOCK})", f"struct(items AS items, {ends(low, 'min')} AS low, {ends(high, 'max')} AS high)")
    return f"filter(transform(sequence(0, (size({array}) - 1) div {BLOCK}), i -> {block}), b -> size(b.items) > 0)"


def tree(array: str, low: str = "s", high: str = "e") -> str:
    """Blocks of blocks of the spans of an array, best in order of their places, for meets()."""
    return let("leaves_", _grouped(array, low, high), _grouped("leaves_", "low", "high"))


def meets(tree_: str, span: str, test: str, low: str = "s", high: str = "e") -> str:
    """Whether a span of the tree (x in the test) shares a place with `span` and passes the test."""
    near = lambda b: f"{b}.low < {span}.{high} AND {b}.high > {span}.{low}"
    return f"exists({tree_}, t -> {near('t')} AND exists(t.items, l -> {near('l')} AND exists(l.items, x -> x.{low} < {span}.{high} AND x.{high} > {span}.{low} AND {test})))"
