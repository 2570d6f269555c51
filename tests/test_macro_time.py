"""macro_time_violations looks at the joined macro frame, not only at a frame that breaks the rule."""

from asofkit import plans


def test_joined_frame_is_counted(spark):
    got = {r["column"]: r["violations"] for r in plans.queries()["macro_time_violations"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 8
    for c in ("1-URGENT_released_at", "2-HIGH_released_at", "other_at"):
        assert got[c] == 0 and got[f"{c} at open"] > 0
    assert got["urgent"] > 0
