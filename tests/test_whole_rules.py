"""All rules, counters and facts have a query that feeds them."""

import __spark_entry__ as entry
from opsframe.operators.metrics import RATE_COUNTERS, RULES
from opsframe.sources.inventory import FACTS


def test_every_rule_can_raise_an_alert(spark, tables):
    found = entry.queries()["w8_all_alerts"](spark, tables)
    assert {r.metric for r in found.select("metric").distinct().collect()} == {r[0] for r in RULES}


def test_every_counter_and_fact(spark, tables):
    rates = entry.queries()["w1_all_counter_rates"](spark, tables)
    assert rates.columns[2:] == [f"{c}_rate" for c in RATE_COUNTERS] and len(RATE_COUNTERS) == 20
    facts = entry.queries()["s16_all_host_facts"](spark, tables)
    assert facts.columns[:-1] == FACTS and len(FACTS) == 32
    assert all(v is not None for v in facts.first())
