"""Registered queries cover whole tables, at any size."""

import pytest

from lattica.plans import registry

SF = "/root/testdata/sf0.001"


def test_batches_overlap_and_cover_the_table(spark):
    whole = {r.event_id for r in registry.t(spark, SF, "events").select("event_id").collect()}
    early = {r.event_id for r in registry._early(spark, SF).collect()}
    late = {r.event_id for r in registry._late(spark, SF).collect()}
    assert early | late == whole and early - late and late - early and early & late


def test_append_and_remove_read_all_rows(spark):
    n = registry.t(spark, SF, "events").count()
    assert sum(r.n for r in registry.QUERIES["update_append"](spark, SF).collect()) == 1.2 * n
    assert {r.event_type for r in registry.QUERIES["update_deltas"](spark, SF).collect()} == {r.event_type for r in registry.t(spark, SF, "events").collect()}
    assert 0 < registry.QUERIES["update_remove"](spark, SF).count() < registry.t(spark, SF, "orders").count()


@pytest.mark.parametrize("name", ["update_upsert", "water_marks"])
def test_stored_side_grows_with_the_table(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "6000" not in plan and "4000" not in plan


@pytest.mark.parametrize("name", ["filter_no_value", "filter_all_date_range"])
def test_filters_without_effect_keep_all_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() == registry.t(spark, SF, "orders").count()
