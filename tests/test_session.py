"""What a scope of written tables leaves behind."""

import os

import pytest

from kinfold.session import _FOLDER, discard, materialize, scratch


def folder(df):
    return getattr(df, _FOLDER).removeprefix("file:")


def test_only_kept_tables_outlive_their_scope(spark):
    before = materialize(spark.range(2), "before")
    with scratch(spark) as keep:
        gone = materialize(spark.range(3), "gone")
        with scratch(spark) as inner:
            held = inner(materialize(gone.where("id > 0"), "held"))
            deep = materialize(spark.range(1), "deep")
        assert not os.path.exists(folder(deep)) and held.count() == 2
        made = keep(materialize(held.where("id > 1"), "made"))
    after = materialize(spark.range(4), "after")
    assert not os.path.exists(folder(gone)) and not os.path.exists(folder(held))
    assert [r.id for r in made.collect()] == [2] and before.count() == 2 and after.count() == 4
    discard(made)
    assert not os.path.exists(folder(made))


def test_a_scope_that_fails_is_cleared(spark):
    with pytest.raises(RuntimeError, match="stop"):
        with scratch(spark):
            lost = materialize(spark.range(3), "lost")
            raise RuntimeError("stop")
    assert not os.path.exists(folder(lost))
    kept = materialize(spark.range(3), "kept")
    assert kept.count() == 3
