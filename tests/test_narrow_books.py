"""Book queries deal and keep only what they need, once."""

import pytest

import __spark_entry__ as entry
from tidemark.operators import book
from tidemark.operators.series import Series


@pytest.mark.parametrize("name, most", [("i35_vol_normalized_book", 7), ("i32_book_depth_features", 8)])
def test_books_are_numbered_once_without_their_levels(spark, sf, monkeypatch, name, most):
    widths, numbered = [], Series.numbered

    def told(self, *args):
        widths.append(len(self.df.columns))
        return numbered(self, *args)

    monkeypatch.setattr(Series, "numbered", told)
    entry.queries()[name](spark, sf)
    assert widths[:1] and len(widths) == 1 and widths[0] <= most


def test_lives_deal_the_rows_twice(spark, monkeypatch):
    dealt, blocked = [], Series._blocked

    def told(self, df):
        dealt.append(self.keys)
        return blocked(self, df)

    monkeypatch.setattr(Series, "_blocked", told)
    rows = [("a", i, i % 20 == 0, "BUY", float(i % 3), float(i % 4)) for i in range(60)]
    changes = spark.createDataFrame(rows, "asset string, seq long, is_snapshot boolean, side string, price double, size double")
    lives = book.level_lives(changes, 25)
    assert lives.count() == 60 and len(dealt) == 2  # by the asset and by the level
