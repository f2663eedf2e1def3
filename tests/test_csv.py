from __future__ import annotations

import csv
import io

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscan.functions.csv import with_csv_text

BAD = "The CSV could not be parsed."


def parsed(spark, contents):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, content binary")
    return {r.i: (r.csv_text, r.csv_error) for r in with_csv_text(df, F.col("content")).collect()}


def test_golden_files(spark):
    cases = [
        (b"a,b\n1,2\n", ("a,b\n1,2\n", None)),
        (b"a,b\r\n007,\"x, y\"\r\n\r\n3", ("a,b\n007,\"x, y\"\n3,\n", None)),
        (b'\xef\xbb\xbfa\n"say ""hi"""\n"two\nlines"\n"plain"', ('a\n"say ""hi"""\n"two\nlines"\nplain\n', None)),
        (b"a,b\n", ("", None)),
        (b"a,b\n1,2,3\n", (None, BAD)),
        (b'a\n"never closed\n', (None, BAD)),
        (b"", (None, BAD)),
        (b"\n\n", (None, BAD)),
        (b"a\n\xff\xfe\n", (None, BAD)),
        (b"a,b\n1,", ("a,b\n1,\n", None)),
        (b'size\n5" pipe\n', ('size\n"5"" pipe"\n', None)),
        ("ä,é\rü,😀\r".encode(), ("ä,é\nü,😀\n", None)),
        (None, (None, None)),
    ]
    assert parsed(spark, [c for c, _ in cases]) == {i: want for i, (_, want) in enumerate(cases)}


def test_long_files_and_fields(spark):
    rows = "".join(f'{i},"x ""{i}"", y"\n' for i in range(50_000))
    field = '"' + '""a,' * 50_000 + '"'
    got = parsed(spark, [("n,t\n" + rows).encode(), f"h\n{field}\n".encode()])
    assert got == {0: ("n,t\n" + rows, None), 1: (f"h\n{field}\n", None)}


cells = st.text(alphabet='ab,"\n é', max_size=5)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.lists(cells, min_size=2, max_size=2), min_size=2, max_size=5), min_size=40, max_size=40))
def test_rows_survive(spark, tables):
    """What a CSV writer wrote reads back as the same cells."""
    files = []
    for rows in tables:
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        files.append(out.getvalue())
    got = parsed(spark, [f.encode() for f in files])
    for i, rows in enumerate(tables):
        assert list(csv.reader(io.StringIO(got[i][0]))) == rows and got[i][1] is None
