"""Conversions stay small enough for the JVM to compile them."""

import re

from tapeloom.contracts import fixed_values as fixed
from tapeloom.operators import quality
from tapeloom.plans import loaders


def test_daily_files_are_read_by_compiled_code(spark, tmp_path, capsys):
    headers = list(fixed.DAILY_FILE_MAPPING)
    numeric = {h for h, c in fixed.DAILY_FILE_MAPPING.items() if c in fixed.NUMERIC_FIELDS}
    values = {"trade_date": "2024-01-02"} | {
        h: " 1.5 " if h in numeric else "600000" for h in headers}
    columns = list(dict.fromkeys(["trade_date", *headers]))
    spark.createDataFrame([tuple(values[c] for c in columns)], columns).write.option("header", "true").csv(
        str(tmp_path / "in"))
    raw = spark.read.option("header", "true").csv(str(tmp_path / "in"))
    shaped = loaders.shape_daily(raw)
    capsys.readouterr()
    shaped.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
    assert shaped.first().close == 1.5


def test_texts_become_numbers_as_one_by_one(spark):
    texts = ["1", " 2.5 ", "nan", "1.5f", "0x1p3", "", "-", None, "-1e3"]
    rows = spark.createDataFrame([(t, t, t, 7) for t in texts], "open string, high string, close string, volume int")
    got = [tuple(r) for r in quality.convert_numeric(rows).collect()]
    want = [1.0, 2.5, None, None, None, None, None, None, -1000.0]
    assert got == [(v, v, v, 7.0) for v in want]
