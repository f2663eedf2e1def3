"""CSV text without a schema: files of a column, each with its own header, as normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.text import BAD_CSV_MESSAGE, sql_text
from veilscan.operators.pin import pinned

#: A field and what ends it; a field that begins with a quote goes on to the closing one, doubled quotes being content.
FIELD = r'((?:"[^"]*+(?:""[^"]*+)*+")?+[^,\r\n]*+)(,|\r\n|\n|\r|\z)'
QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)\z'


def _value(field: str) -> str:
    """What a field means, and that as a field with quotes only where needed."""
    bare = f"concat(replace(regexp_extract({field}, {sql_text(QUOTED)}, 1), '\"\"', '\"'), regexp_extract({field}, {sql_text(QUOTED)}, 2))"
    meant = f"if({field} rlike {sql_text(QUOTED)}, {bare}, {field})"
    needs = sql_text(r'[",\r\n]')
    again = f"concat('\"', replace({meant}, '\"', '\"\"'), '\"')"
    return f"if({field} rlike {needs}, if({meant} rlike {needs}, {again}, {meant}), {field})"


def with_csv_text(df: DataFrame, content: Column) -> DataFrame:
    """Add ``csv_text`` and ``csv_error``: the header and one line for each row, in normal form.

    All cells stay strings as they are, short rows are filled up with empty cells, blank lines are left out, and a
    table without rows gives ''.  Bytes that are no UTF-8, no lines at all, a row longer than the header and a quote
    that never closes are errors.  Null content gives neither text nor error.
    """
    text = F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", ""))
    read = pinned(df, _there=content.isNotNull(), _text=text)
    pattern = sql_text(FIELD)
    cut = pinned(
        read,
        _fields=F.expr(f"regexp_extract_all(_text, {pattern}, 1)"),
        _ends=F.expr(f"regexp_extract_all(_text, {pattern}, 2)"),
    ).drop("_text")
    # the end of the text is a field only after a comma
    last = "if(size(_ends) > 1 and element_at(_ends, -1) = '' and element_at(_ends, -2) = ',', 0, if(element_at(_fields, -1) = '', 1, 0))"
    counted = pinned(cut, _n=F.expr(f"if(size(_ends) > 0, size(_ends) - {last}, 0)"))
    stops = "filter(sequence(0, _n - 1), i -> _ends[i] != ',')"
    lines = pinned(counted, _stops=F.expr(f"if(_n > 0, {stops}, cast(array() as array<int>))"))
    rows = "transform(_stops, (e, k) -> slice(_fields, if(k = 0, 1, _stops[k - 1] + 2), if(k = 0, e + 1, e - _stops[k - 1])))"
    rows = pinned(lines, _rows=F.expr(f"filter({rows}, r -> size(r) > 1 or r[0] != '')")).drop("_fields", "_ends", "_n", "_stops")
    line = f"concat(array_join(transform(r, f -> {_value('f')}), ','), repeat(',', size(_rows[0]) - size(r)), '\\n')"
    open_quote = f"exists(r, f -> startswith(f, '\"') and not f rlike {sql_text(QUOTED)})"
    bad = F.expr(f"coalesce(size(_rows) = 0 or exists(_rows, r -> size(r) > size(_rows[0]) or {open_quote}), true)")
    whole = F.expr(f"if(size(_rows) > 1, array_join(transform(_rows, r -> {line}), ''), '')")
    judged = pinned(rows, _bad=F.col("_there") & bad)
    return judged.select(
        *df.columns,
        F.when(F.col("_there") & ~F.col("_bad"), whole).alias("csv_text"),
        F.when(F.col("_bad"), F.lit(BAD_CSV_MESSAGE)).alias("csv_error"),
    )
