"""Matches of rules in a text, with code-point offsets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.arrays import let, running_state
from veilscan.functions.masking import mask_sql
from veilscan.functions.text import LUHN_SQL, sql_text, strip_sql
from veilscan.settings import Gate, Rule

NO_TEXT = "cast(array() as array<string>)"
#: Put around matches; a text that holds it itself is cut by patterns instead.
MARK = "\ue000"


def all_matches(text: str, rule: Rule, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {sql_text(rule.pattern)}, {group})"


def gate_sql(text: str, gates: list[Gate]) -> str:
    """True when the text may have a match of a rule with one of the gates."""
    first = "".join(dict.fromkeys(g.first for g in gates))
    union = f"(?=[{first}])(?:" + "|".join(dict.fromkeys(g.pattern for g in gates)) + ")"
    return f"coalesce({text} rlike {sql_text(union)}, false)"


def hits_sql(text: str, rule: Rule, possible: list[str]) -> str:
    """Every leftmost, non-overlapping match; an empty array when there is none.

    The pattern is only tried when all ``possible`` conditions hold.
    """
    hits = f"coalesce({all_matches(text, rule)}, {NO_TEXT})"
    if not possible:
        return hits
    return f"case when {' and '.join(possible)} then {hits} else {NO_TEXT} end"


def possible_sql(text: str, rule: Rule, prefilter: bool, gate: str | None) -> list[str]:
    """What must hold for a text to have a match."""
    possible = [gate] if gate else []
    if prefilter and rule.needs:
        found = " or ".join(f"contains({text}, {sql_text(literal)})" for literal in rule.needs)
        possible.append(f"({found})")
    return possible


def rule_hits(text: str, rule: Rule, prefilter: bool = True, gate: str | None = None) -> Column:
    """Matches of a rule; ``gate`` names a column that says whether to try."""
    return F.expr(hits_sql(text, rule, possible_sql(text, rule, prefilter, gate)))


def rule_marks(text: str, rule: Rule, prefilter: bool = True, gate: str | None = None) -> Column:
    """The text with marks around the matches of a rule."""
    return F.expr(marked_sql(text, rule, possible_sql(text, rule, prefilter, gate)))


def marked_sql(text: str, rule: Rule, possible: list[str]) -> str:
    """The text with marks around every leftmost, non-overlapping match, and around its groups; NULL where none is possible.

    The pattern walks the text once.  NULL too for a text that holds the mark itself.
    """
    pattern, marks = rule.pattern, f"{MARK}$0{MARK}"
    if rule.grouped:
        pattern = pattern[: len(pattern) - len(rule.after)] + f"({rule.after})"
        marks = f"{MARK}$1{MARK}$2{MARK}$3{MARK}"
    marked = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(marks)})"
    return f"case when {' and '.join([*possible, f'not contains({text}, {sql_text(MARK)})'])} then {marked} end"


def parts_sql(text: str, rule: Rule, marked: str, unmarked: str) -> str:
    """``struct<category, parts>`` of one rule; parts hold (gap, hit, lead, value).

    ``gap`` is the text between the previous match and this one, ``lead`` the part of
    the match before the reported value.  Lengths of gaps and hits add up to offsets
    without asking the regex engine for positions.  ``unmarked`` is SQL that tells
    texts which hold the mark themselves; texts without a hit are not split.
    """
    step = 4 if rule.grouped else 2

    def piece(n: int) -> str:
        return f"pieces_[{step} * i + {n}]"

    if rule.grouped:
        fields = f"'hit', length({piece(1)}) + length({piece(2)}) + length({piece(3)}), 'lead', length({piece(1)}), 'value', {piece(2)}"
    else:
        fields = f"'hit', length({piece(1)}), 'lead', 0, 'value', {piece(1)}"
    cut = let(
        "pieces_", f"split({marked}, {sql_text(MARK)}, -1)",
        f"transform(sequence(0, cast(size(pieces_) div {step} as int) - 1), i -> named_struct('gap', length({piece(0)}), {fields}))",
    )
    parts = f"case when {unmarked} then {split_parts_sql(text, rule)} when contains({marked}, {sql_text(MARK)}) then {cut} end"
    return f"named_struct('category', {sql_text(rule.category)}, 'parts', {parts})"


def split_parts_sql(text: str, rule: Rule) -> str:
    """The same parts, by splitting the text at the pattern, which walks it as the extraction does."""
    hits = "hits_"
    gaps = f"slice(split({text}, {sql_text(rule.pattern)}, -1), 1, size({hits}))"
    if rule.grouped:
        lead, value = all_matches(text, rule, 1), all_matches(text, rule, 2)
    else:
        lead, value = f"array_repeat('', size({hits}))", hits
    parts = (
        f"zip_with(zip_with({gaps}, {hits}, (g, h) -> named_struct('gap', length(g), 'hit', length(h))), "
        f"zip_with({lead}, {value}, (l, v) -> named_struct('lead', length(l), 'value', v)), "
        f"(a, b) -> named_struct('gap', a.gap, 'hit', a.hit, 'lead', b.lead, 'value', b.value))"
    )
    return let(hits, all_matches(text, rule), f"case when size({hits}) > 0 then {parts} end")


def number_sql(text: str, rule: Rule, hits: str) -> str:
    """Number of findings among the matches of a rule."""
    known_check(rule)
    if rule.check is None:
        return f"size({hits})"
    values = f"case when size({hits}) > 0 then {all_matches(text, rule, 2)} else {hits} end" if rule.grouped else hits
    return f"size(filter({values}, v_ -> {LUHN_SQL.format(v='v_')}))"


def known_check(rule: Rule) -> None:
    if rule.check not in (None, "luhn"):
        raise ValueError(f"unknown check {rule.check!r}")


def spans_sql(matched: str, rules: tuple[Rule, ...]) -> str:
    """All findings from an array of ``parts_sql`` structs that have parts."""
    span = let(
        "start_", "w.at + w.part.gap + w.part.lead",
        "named_struct('start', start_, 'category', m.category, 'end', start_ + length(w.part.value), "
        f"'value', {strip_sql('w.part.value')}, 'masked_value', {mask_sql('m.category', 'w.part.value', rules)})",
    )
    begins = f"if(size(m.parts) = 1, array(0), {running_state('m.parts', 's + x.gap + x.hit')})"
    placed = f"zip_with(m.parts, {begins}, (part, at) -> named_struct('part', part, 'at', at))"
    spans = f"flatten(transform({matched}, m -> transform({placed}, w -> {span})))"
    for r in rules:
        known_check(r)
    checked = [sql_text(r.category) for r in rules if r.check == "luhn"]
    if not checked:
        return spans
    return f"filter({spans}, f -> f.category not in ({', '.join(checked)}) or {LUHN_SQL.format(v='f.value')})"
