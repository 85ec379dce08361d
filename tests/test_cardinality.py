"""Directories that hold a key twice must not double anything silently."""

from __future__ import annotations

import re

import pytest
from test_plans import plan

from clientlens.model import Slice
from clientlens.operators import conform, listings, rankings
from clientlens.operators.cardinality import one_row_each
from clientlens.plans.mapping import WINDOWS

LISTINGS = {
    "country listing": lambda t: listings.country_listing(t, WINDOWS),
    "idle countries": lambda t: listings.idle_country_listing(t, WINDOWS, part=Slice(division=3, subdivision=107)),
    "client listing": lambda t: listings.client_listing(t, WINDOWS),
    "clients of a region": lambda t: listings.client_listing(t, WINDOWS, part=Slice(region=2)),
    "idle clients": lambda t: listings.idle_client_listing(t, WINDOWS, part=Slice(division=3, subdivision=107)),
    "idle clients of divisions": lambda t: listings.idle_snapshot_all_divisions(t, WINDOWS, (3, 225)),
    "enquiries": lambda t: listings.enquiry_status_rollup(t, "country"),
    "invoices": lambda t: listings.invoice_rollup(t, "client"),
    "client view": lambda t: conform.client_activity(t["client_activity"], t["client"], t["temp_client"], t["client_type"], WINDOWS),
    "top clients": lambda t: rankings.top_clients_by_enquiry(t, WINDOWS),
}


def with_twice(sample, name: str, where: str):
    """The sample tables, some rows of one of them twice."""
    tables = {n: sample[n] for n in ("client", "temp_client", "country", "region", "client_type", "client_activity", "enquiry", "invoice")}
    rows = tables[name]
    tables[name] = rows.unionAll(rows.where(where))
    return tables


@pytest.mark.parametrize("name", LISTINGS)
def test_a_repeated_client_fails_the_listing(name, sample):
    with pytest.raises(Exception, match="the directory of clients must have one row for each key, but has several for client_ref"):
        LISTINGS[name](with_twice(sample, "client", "true")).collect()


@pytest.mark.parametrize("name", ["country listing", "idle countries", "enquiries"])
def test_a_repeated_country_fails_the_listing(name, sample):
    with pytest.raises(Exception, match="the table of countries must have one row for each key, but has several for "):
        LISTINGS[name](with_twice(sample, "country", "true")).collect()


def test_the_message_names_the_key(frame):
    rows = frame("a INT, b STRING", (1, "x"), (2, None), (2, None))
    with pytest.raises(Exception, match="the table must have one row for each key, but has several for a 2, b null"):
        one_row_each(rows, "a", "b", of="the table").collect()
    assert sorted(one_row_each(rows.distinct(), "a", "b", of="the table").collect()) == sorted(rows.distinct().collect())


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
@pytest.mark.parametrize("name", ["country listing", "client listing", "clients of a region", "idle clients", "enquiries", "client view", "top clients"])
def test_the_check_costs_no_shuffle(name, broadcast, spark, snapshots, monkeypatch):
    """Of clients and facts; where the few countries are broadcast, counting them deals them anew."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        checked = plan(LISTINGS[name](snapshots), "simple")
        for module in (listings, conform, rankings):
            monkeypatch.setattr(module, "one_row_each", lambda df, *key, of: df)
        plain = plan(LISTINGS[name](snapshots), "simple")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_rows_of_key" in checked and "_rows_of_key" not in plain
    count = lambda text: len(re.findall(r"Exchange hashpartitioning\((?!country_id|id)", text))
    assert count(checked) == count(plain)
    if broadcast == "-1":
        assert checked.count("Exchange hashpartitioning(") == plain.count("Exchange hashpartitioning(")
