"""Rows of a Spark query and of its SQL in DuckDB, compared as sorted text."""

import math


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x)


def assert_same(spark_df, duck, sql: str) -> int:
    found = duck.execute(sql)
    columns = sorted(spark_df.columns)
    assert columns == sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted([plain(r[i]) for i in at] for r in found.fetchall())
    got = sorted([plain(r[c]) for c in columns] for r in spark_df.collect())
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, f"{len(wrong)} of {len(got)} rows differ: {wrong[:3]}"
    return len(got)
