"""Masking of single values and of whole texts, as SQL for ``F.expr``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.arrays import BLOCK, in_blocks, let, running_state
from veilscan.functions.text import sql_text, strip_sql
from veilscan.settings import RULES, Rule

# The styles, over a stripped, non-empty value ``v``.
EDGES = (
    "case when length(v) <= 4 then repeat('*', length(v)) "
    "else concat(left(v, 2), repeat('*', greatest(3, length(v) - 4)), right(v, 2)) end"
)
EMAIL_PARTS = (
    "concat(left(local_, if(length(local_) > 2, 2, 1)), "
    "repeat('*', greatest(4, length(local_) - if(length(local_) > 2, 2, least(1, length(local_))))), "
    "substring(v, length(local_) + 1))"
)
MASK_STYLES = {
    "edges": EDGES,
    "email": f"case when contains(v, '@') then {let('local_', "substring_index(v, '@', 1)", EMAIL_PARTS)} else {EDGES} end",
    "pan": "case when length(v) >= 10 then concat(left(v, 3), '****', right(v, 3)) else repeat('*', length(v)) end",
    "digits": let(
        "d_", "regexp_replace(v, '[^\\\\p{Nd}]', '')",
        f"case when length(d_) >= 4 then concat(repeat('X', length(d_) - 4), right(d_, 4)) else {EDGES} end",
    ),
    "secret": (
        "case when length(v) > 8 then concat(left(v, 3), repeat('*', greatest(6, length(v) - 6)), right(v, 3)) "
        "else repeat('*', length(v)) end"
    ),
}


def mask_sql(category: str, value: str, rules: tuple[Rule, ...] = RULES) -> str:
    by_style: dict[str, list[str]] = {}
    for rule in rules:
        by_style.setdefault(rule.mask, []).append(sql_text(rule.category))
    ladder = "case when length(v) = 0 then v "
    for style, categories in by_style.items():
        if style != "edges":
            ladder += f"when {category} in ({', '.join(categories)}) then {MASK_STYLES[style]} "
    return let("v", strip_sql(value), f"{ladder} else {EDGES} end")


def mask_value(category: str, value: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Mask by category; unknown categories use the 'edges' style, empty stays empty."""
    return F.expr(mask_sql(category, value, rules))


def mask_text(text: str, findings: str) -> Column:
    """Text with every finding replaced by its mask.

    Findings are defined to be replaced from right to left (start descending, then
    category ascending), each cut using offsets of the *original* text.  When two
    findings overlap, the later cut therefore removes characters that follow the
    earlier mask.  Read from the left that is a running debt: a finding owes its own
    span, and whatever comes next (masks and gaps alike) is dropped until the debt is
    paid.  So one pass with an integer state gives the exact result, overlapping or
    not, and the text is cut once per finding instead of copied once per finding.
    """
    # In text order, ties by category descending: the reverse of the replacement order.
    ordered = (
        f"reverse(array_sort(transform({findings}, f -> named_struct("
        "'back', -f.start, 'category', f.category, 'until', f.end, 'mask', f.masked_value))))"
    )
    # Each edit knows where the next one starts; the last one ends with the text.
    edits = let("o", ordered, (
        f"zip_with(o, concat(slice(transform(o, f -> -f.back), 2, size(o)), array(length({text}))), "
        "(f, following) -> named_struct('start', -f.back, 'until', f.until, 'following', following, 'mask', f.mask))"
    ))
    # Debt after a mask is written, and after the gap that follows it.
    owed = "greatest({debt} - length({e}.mask), 0) + {e}.until - {e}.start"
    after_mask = owed.format(debt="s", e="x")
    debts = running_state("edits_", f"greatest({after_mask} - (x.following - x.start), 0)")
    pieces = (
        f"zip_with(edits_, {debts}, (e, debt) -> named_struct("
        "'mask', substring(e.mask, debt + 1), "
        f"'low', least(e.start + {owed.format(debt='debt', e='e')}, e.following), "
        "'start', e.start, 'following', e.following))"
    )
    # A position is found by walking from the beginning, so the text is cut into windows, and these again.
    def windows(pieces: str, size: int, name: str, source: str, offset: str, inner) -> str:
        base, cut = f"{name}base", f"{name}text"
        inside = let(base, f"element_at({name}, 1).start", let(
            cut, f"substring({source}, {base} - {offset} + 1, element_at({name}, -1).following - {base})", inner(name, cut, base)
        ))
        return f"array_join(transform({in_blocks(pieces, size)}, {name} -> {inside}), '')"

    def rendered(run: str, source: str, offset: str) -> str:
        one = f"p -> concat(p.mask, substring({source}, p.low - {offset} + 1, p.following - p.low))"
        return f"array_join(transform({run}, {one}), '')"

    whole = windows("pieces_", BLOCK * BLOCK, "wide_", text, "0", lambda wide, source, offset: windows(wide, BLOCK, "run_", source, offset, rendered))
    body = f"concat(substring({text}, 1, element_at(edits_, 1).start), {let('pieces_', pieces, whole)})"
    return F.expr(f"case when size({findings}) > 0 then {let('edits_', edits, body)} else {text} end")
