"""A count of events up to a moment never shrinks, so nothing is deleted between two moments."""

import __spark_entry__ as entry


def test_no_state_is_deleted_between_two_moments(spark, tables):
    found = entry.queries()["j11_states_diff"](spark, tables).collect()
    assert found and all(r.change in ("add", "move") and r.new_n > (r.old_n or 0) for r in found)
