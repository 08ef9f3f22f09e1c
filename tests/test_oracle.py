"""Every registered query of the library runs, and equals its SQL where it has one."""

import decimal
import math

import pytest

from cairn.plans import registry


def plain(value):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return round(number, 9) if math.isfinite(number) else str(number)
    return str(value)


def rows_of(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows_of([r[c] for c in columns] for r in df.collect())
    if name not in registry.SQL:
        assert got
    else:
        result = duck.execute(registry.SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == rows_of([r[names.index(c)] for c in columns] for r in result.fetchall())


def test_everything_is_registered_once():
    total = sum(len(m.QUERIES) for m in registry.MODULES)
    assert total == len(registry.QUERIES)
    assert set(registry.SQL) <= set(registry.QUERIES)
