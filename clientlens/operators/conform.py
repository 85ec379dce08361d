"""Conformed views: one client key, one country and one amount for every fact.

A client is referred to by one BIGINT, `client_ref`: the number of a registered client, or
the negative of a temporary client's id. The two id spaces cannot collide, a client costs
one join instead of two, and facts without a client do not pile up on a second join's null key.
Names are attached after aggregation wherever that is possible, so that the fact tables
are reduced map-side before anything is shuffled and a client with a third of all rows is no
hot join key. Small dimensions carry no broadcast hint: Spark broadcasts a side only below
its size threshold, and at run time AQE may still decide to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions import exact_money, exact_rate
from clientlens.model import EXCLUDED_SECTOR, NO_SLICE, Slice, Windows
from clientlens.operators.cardinality import one_row_each
from clientlens.operators.slices import VIEW_COLUMNS, slice_by

DIRECTORY = "the directory of clients"


def _number(col: Column) -> Column:
    """Text ids may be blank; a plain cast would fail under ANSI rules."""
    return F.nullif(F.trim(col.cast("string")), F.lit("")).try_cast("int")


def client_ref(debtor_no: Column, temp_client_id: Column) -> Column:
    """One key for both kinds of client; 0 and negative ids count as missing."""
    registered = F.when(debtor_no > 0, debtor_no.cast("bigint"))
    temporary = F.when(temp_client_id > 0, -temp_client_id.cast("bigint"))
    return F.coalesce(registered, temporary)


def client_key(ref: Column) -> Column:
    """The key as people read it: `5` for a registered client, `TMP5` for a temporary one."""
    return F.when(ref > 0, ref.cast("string")).when(
        ref < 0, F.concat(F.lit("TMP"), (-ref).cast("string"))
    )


def amount(value: Column, rate: Column) -> Column:
    return exact_money(value) * exact_rate(rate)


def client_directory(client: DataFrame, temp_client: DataFrame) -> DataFrame:
    """Registered and temporary clients under one key; unique by `client_ref`."""
    registered = client.filter(F.col("debtor_no") > 0).select(
        F.col("debtor_no").cast("bigint").alias("client_ref"),
        F.col("name").alias("client_name"),
        F.col("country").cast("int").alias("country_id"),
        F.col("client_type").cast("int").alias("client_type"),
        F.col("client_status").cast("int").alias("status_id"),
    )
    temporary = temp_client.filter(F.col("temp_clients_id") > 0).select(
        (-F.col("temp_clients_id")).cast("bigint").alias("client_ref"),
        F.col("client_name"),
        _number(F.col("country")).alias("country_id"),
        _number(F.col("temp_client_type")).alias("client_type"),
        F.lit(None).cast("int").alias("status_id"),
    )
    return registered.unionByName(temporary)


def attach_country(df: DataFrame, country: DataFrame, region: DataFrame) -> DataFrame:
    """Country name, colour and region of rows with a `country_id`.

    Two joins to base tables, not one to their join: Spark knows the size of a table, but can
    only guess that of a join, and the guess may be too big to broadcast.
    """
    countries = country.select(
        F.col("id").alias("country_id"),
        F.col("name").alias("country_name"),
        "colour_code",
        "region_id",
    )
    regions = region.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    return df.join(countries, "country_id", "left").join(regions, "region_id", "left")


def resolve_client(facts: DataFrame, client: DataFrame, temp_client: DataFrame) -> DataFrame:
    """Key, name, country and sector of the client behind every enquiry."""
    directory = client_directory(client, temp_client).withColumnsRenamed(
        {"country_id": "client_country", "client_type": "client_sector"}
    ).drop("status_id")
    ref = client_ref(F.col("debtor_no"), F.col("enquiry_temp_id"))
    return (
        facts.withColumn("client_ref", ref)
        .join(directory, "client_ref", "left")
        .withColumn("client_key", client_key(F.col("client_ref")))
    )


def enquiry_view(
    enquiry: DataFrame,
    client: DataFrame,
    temp_client: DataFrame,
    country: DataFrame,
    region: DataFrame,
) -> DataFrame:
    """Every enquiry with its client, country, region, sector and amount."""
    facts = enquiry.select(
        "client_enquiry_id",
        client_ref(F.col("debtor_no"), F.col("enquiry_temp_id")).alias("client_ref"),
        "enq_status",
        "enquiry_date",
        "division",
        F.col("subdivision").alias("sub_division"),
        amount(F.col("aprox_amount"), F.col("rate")).alias("amount"),
    )
    directory = client_directory(client, temp_client).drop("status_id", "client_name")
    resolved = facts.join(directory, "client_ref", "left").filter(
        F.col("client_type") != EXCLUDED_SECTOR
    )
    return (
        attach_country(resolved, country, region)
        .withColumn("client_key", client_key(F.col("client_ref")))
        .drop("colour_code")
    )


def gross_net_amounts(invoice: DataFrame) -> DataFrame:
    """Gross, net of expense, and outstanding amount of every invoice."""
    rate = exact_rate(F.col("rate"))
    gross = exact_money(F.col("ov_amount")) * rate
    expense = F.coalesce(exact_money(F.col("total_expense_aed")), F.lit(0).cast("decimal(18,4)"))
    return invoice.withColumns(
        {
            "gross_amount": gross,
            "net_amount": gross - expense,
            "outstanding": (exact_money(F.col("ov_amount")) - exact_money(F.col("alloc"))) * rate,
        }
    )


def invoice_view(
    invoice: DataFrame, client: DataFrame, country: DataFrame, region: DataFrame
) -> DataFrame:
    """Every invoice of a client with known country, with region, sector and net amount."""
    facts = gross_net_amounts(invoice).select(
        F.col("trans_no").alias("invoice_no"),
        F.col("debtor_no").cast("bigint").alias("debtor_no"),
        "tran_date",
        F.col("dimension2_id").alias("division"),
        F.col("dimension3_id").alias("sub_division"),
        F.col("net_amount").alias("invoice_amount"),
    )
    known = (
        client.select(
            F.col("debtor_no").cast("bigint").alias("debtor_no"),
            F.col("country").cast("int").alias("country_id"),
            F.col("client_type").cast("int").alias("client_type"),
        )
        .filter(F.col("country_id").isNotNull())
        .filter(F.col("client_type") != EXCLUDED_SECTOR)
    )
    return attach_country(facts.join(known, "debtor_no"), country, region).drop(
        "country_name", "region_name", "colour_code"
    )


def _live(activity: DataFrame) -> DataFrame:
    return activity.filter(
        (F.col("country_id") > 0) & (F.col("client_type") != EXCLUDED_SECTOR)
    )


def country_activity(
    activity: DataFrame, country: DataFrame, region: DataFrame, part: Slice = NO_SLICE
) -> DataFrame:
    """C4: last enquiry and last job of every country inside the slice.

    The facts shrink to one row per country and region before names are joined.
    """
    small = (
        slice_by(_live(activity), part)
        .groupBy("country_id", "region_id")
        .agg(F.max("enquiry_date").alias("enquiry_date"), F.max("job_date").alias("job_date"))
    )
    countries = country.select(F.col("id").alias("country_id"), F.col("name").alias("country_name"))
    regions = region.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    return (
        small.join(countries, "country_id", "left")
        .join(regions, "region_id", "left")
        .groupBy("country_id", "country_name")
        .agg(
            F.min("region_name").alias("region_name"),
            F.max("enquiry_date").alias("enquiry_date"),
            F.max("job_date").alias("job_date"),
        )
    )


def client_last(activity: DataFrame, w: Windows, part: Slice = NO_SLICE) -> DataFrame:
    """Last enquiry and job per client inside the slice, keyed by `client_ref`."""
    return (
        slice_by(_live(activity), part)
        .filter(F.col("enquiry_date") >= F.lit(w.floor))
        .withColumn("client_ref", client_ref(F.col("debtor_no"), F.col("temp_client_id")))
        .filter(F.col("client_ref").isNotNull())
        .groupBy("client_ref")
        .agg(
            F.max("enquiry_date").alias("enquiry_date"),
            F.max("job_date").alias("job_date"),
            F.min("division").alias("division"),
            F.min("sub_division").alias("sub_division"),
            F.min("client_type").alias("sector_id"),
        )
    )


def client_activity(
    activity: DataFrame,
    client: DataFrame,
    temp_client: DataFrame,
    client_type: DataFrame,
    w: Windows,
    part: Slice = NO_SLICE,
) -> DataFrame:
    """One row per client inside the slice, with its last enquiry and job."""
    named = with_directory(client_last(activity, w, part), client, temp_client)
    return with_sector_names(named, client_type).drop("home_country", "home_sector")


def with_directory(
    df: DataFrame, client: DataFrame, temp_client: DataFrame, key: tuple[str, ...] = ("client_ref",)
) -> DataFrame:
    """Name, status, home country and sector, and readable ids for rows that are one for each `key`.

    A directory that makes them more is an error.
    """
    ref = F.col("client_ref")
    directory = client_directory(client, temp_client).withColumnsRenamed(
        {"country_id": "home_country", "client_type": "home_sector"}
    )
    named = one_row_each(df.join(directory, "client_ref", "left"), *key, of=DIRECTORY)
    return named.withColumns(
        {
            "debtor_no": F.when(ref > 0, ref),
            "temp_client_id": F.when(ref < 0, -ref).otherwise(F.lit(0).cast("bigint")),
            "client_id": F.abs(ref).cast("string"),
            "client_status": F.when(ref < 0, client_key(ref)).otherwise(F.lit("")),
        }
    )


def with_sector_names(df: DataFrame, client_type: DataFrame) -> DataFrame:
    sectors = client_type.select(F.col("id").alias("sector_id"), F.col("client_type"))
    return df.join(sectors, "sector_id", "left")


def activity_code_summary(
    code_activity: DataFrame,
    job_activity: DataFrame,
    country: DataFrame,
    region: DataFrame,
    part: Slice = NO_SLICE,
) -> DataFrame:
    """Last enquiry and job of every live activity code.

    A code without activity has no sector and so fails the sector rule; the join is an
    inner one. Division and sub-division of a slice are those of the code itself. Of several
    countries of a code the one with the lowest id is shown, with its region.

    The activity is reduced to one row per code before it meets the codes, so a code with a
    third of all rows is no hot join key.
    """
    code = F.col("activity_code")
    used = slice_by(code_activity, part.only("country", "sector")).filter(
        F.col("client_type") != EXCLUDED_SECTOR
    )
    if part.region is not None:
        inside = country.filter(F.col("region_id") == part.region)
        used = used.join(inside.select(F.col("id").alias("country_id")), "country_id", "left_semi")
    last = used.groupBy(code).agg(
        F.max("enquiry_date").alias("enquiry_date"),
        F.max("job_date").alias("job_date"),
        F.min("country_id").alias("country_id"),
        F.min("debtor_no").alias("debtor_no"),
        F.min("client_type").alias("client_type"),
        F.min("division").alias("division"),
        F.min("sub_division").alias("sub_division"),
    )
    live = slice_by(
        job_activity.filter((code != "") & (F.col("status") == 1)),
        part.only("division", "subdivision"),
        {**VIEW_COLUMNS, "division": "division_id", "subdivision": "sub_division_id"},
    )
    known = last.join(live.select("activity_code"), "activity_code", "left_semi")
    return attach_country(known, country, region).drop("country_id", "colour_code")


def last_activity_by_division(activity: DataFrame) -> DataFrame:
    """Last enquiry and job of every registered client in every division."""
    return (
        activity.filter(F.col("debtor_no") > 0)
        .groupBy("debtor_no", "division")
        .agg(
            F.max("job_date").alias("last_job_date"),
            F.max("enquiry_date").alias("last_enquiry_date"),
        )
    )
