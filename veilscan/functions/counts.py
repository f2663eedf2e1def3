"""Category counts of one document, as map expressions over a column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.arrays import let


def counts_map(findings: str) -> Column:
    """``map<category,count>`` of a findings array; no zero entries, keys sorted."""
    entries = "transform(names_, c -> size(filter({0}, f -> f.category = c)))".format(findings)
    names = f"array_sort(array_distinct(transform({findings}, f -> f.category)))"
    return F.expr(let("names_", names, f"map_from_arrays(names_, {entries})"))


def total_sql(counts: str) -> str:
    return f"aggregate(map_values({counts}), 0, (acc, n) -> acc + n)"


def total(counts: str) -> Column:
    """Number of findings."""
    return F.expr(total_sql(counts))


def category_list(counts: str, empty: str) -> Column:
    """Sorted category names joined by ', ', or ``empty``."""
    names = F.expr(f"array_join(array_sort(map_keys({counts})), ', ')")
    return F.when(F.size(counts) > 0, names).otherwise(F.lit(empty))


def counts_text(counts: str) -> Column:
    """One ``- category: n`` line per category in name order, or 'None'."""
    return F.expr(
        f"if(size({counts}) > 0, array_join(transform(array_sort(map_entries({counts})), "
        f"e -> concat('- ', e.key, ': ', e.value)), '\\n'), 'None')"
    )


def counts_json(counts: str) -> Column:
    """JSON object with sorted keys and ', ' / ': ' separators."""
    quoted = "regexp_extract(to_json(array(e.key)), '(?s)^\\\\[(.*)\\\\]\\\\z', 1)"
    return F.expr(
        f"concat('{{', array_join(transform(array_sort(map_entries({counts})), "
        f"e -> concat({quoted}, ': ', e.value)), ', '), '}}')"
    )
