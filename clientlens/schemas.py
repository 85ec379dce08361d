"""Declared schema of every extracted table, so that no later stage has to repair types.

Money is DECIMAL(18,4) and exchange rates are DECIMAL(12,6): sums over them are exact,
whatever order the partitions arrive in.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_ACTIVITY = """
    id BIGINT, {code}temp_client INT, debtor_no BIGINT, division INT, sub_division INT,
    enquiry_date DATE, job_date DATE, enquiry_no BIGINT, sales_order_no BIGINT,
    no_data INT, not_applicable INT, f_enquiry_date DATE, f_enquiry_no BIGINT,
    f_job_date DATE, f_sales_order_no BIGINT, country_id INT, region_id INT,
    client_type INT, temp_client_id BIGINT, enquiry_temp_id BIGINT{tail}
"""

# Column names of the source tables.
DDL = {
    "client": """
        debtor_no BIGINT, debtor_code STRING, name STRING, address STRING, po_box STRING,
        city STRING, country INT, phone STRING, fax STRING, email STRING, added_date DATE,
        client_credit_days INT, curr_code STRING, client_type INT, area INT, client_status INT
    """,
    "temp_client": """
        temp_clients_id BIGINT, client_name STRING, country STRING, area STRING,
        temp_client_type STRING
    """,
    "sales_order": """
        order_no BIGINT, trans_type INT, job_type INT, job_title STRING, debtor_no BIGINT,
        branch_code INT, reference STRING, ord_date DATE, dimension_id INT,
        dimension2_id INT, dimension3_id INT, rate DECIMAL(12,6)
    """,
    "sales_order_reference": """
        sales_order_reference_id BIGINT, trans_type INT, trans_no BIGINT,
        ref_trans_type INT, ref_trans_no BIGINT, reference STRING
    """,
    "payment_allocation": """
        id BIGINT, alloc_amount DECIMAL(18,4), amt DECIMAL(18,4), date_alloc DATE,
        trans_no_from BIGINT, trans_type_from INT, trans_no_to BIGINT, trans_type_to INT,
        bank_rate DECIMAL(12,6)
    """,
    "client_status": """
        id INT, client_status STRING, dissallow_job INT, dissallow_enquiry INT,
        dissallow_quotation INT, dissallow_invoice INT, category INT
    """,
    "client_type": "id INT, client_type STRING",
    "credit_period": """
        id BIGINT, debtor_no BIGINT, min_credit_period INT, date_of_min_payment DATE,
        min_inv_date DATE, min_trans_no BIGINT, current_credit_period INT,
        date_of_curr_pmnt DATE, curr_trans_no BIGINT, curr_inv_date DATE
    """,
    "country": "id INT, name STRING, region_id INT, colour_code STRING",
    "region": "id INT, name STRING",
    "dimension": """
        id INT, reference STRING, name STRING, full_name STRING, sap_name STRING, type_ INT,
        parent INT, closed INT, date_ DATE, due_date DATE, po_box STRING, city STRING,
        telephone STRING, fax STRING, company_currency STRING, country INT,
        job_prefix STRING, divisions STRING, asset STRING, liability STRING,
        transfer_account STRING, voucher_name STRING, incentive_account STRING,
        salary_bank_account STRING, salary_cash_account STRING, folder_name STRING,
        ratio DOUBLE, branch_id INT, location_id INT, email STRING, active INT, is_tree INT,
        time_zone STRING, logo_sourcefile STRING, logo_image STRING,
        letterhead_sourcefile STRING, letterhead_image STRING, trade_license STRING,
        vat_applicable INT, display_in_report INT, sort_order INT, gstin STRING,
        state_id INT, pan_number STRING, tax_mode INT, tax_label STRING,
        display_client_tax_no INT, vat_no STRING, des STRING, close_date_ DATE,
        invoice_template_id INT, added_by INT, added_date DATE, address STRING,
        is_sap_company INT
    """,
    "enquiry": """
        client_enquiry_id BIGINT, branch_code INT, debtor_no BIGINT, contact_id BIGINT,
        temp_contact_id BIGINT, enquiry_date DATE, company INT, orginating_company INT,
        division INT, subdivision INT, received_by STRING, person_in_charge STRING,
        mod_of_com INT, description STRING, reply_date DATE, replied_by STRING,
        vessel_name STRING, place_of_survey STRING, place_of_survey_country INT,
        vessel_class_id1 INT, vessel_class_id2 INT, enq_status INT, status_remarks STRING,
        is_international INT, job_no STRING, is_job_alloted INT, is_existing_client INT,
        followup INT, next_followup_date DATE, written_no STRING, remarks STRING,
        job_title STRING, is_quoted INT, is_email INT, email_date DATE, email_remark STRING,
        email_version INT, email_by STRING, expected_date DATE, book_no STRING,
        aprox_amount DECIMAL(18,4), enquiry_from INT, activity_code STRING,
        created_date DATE, status_date DATE, lost_description STRING, enquiry_ref_id BIGINT,
        transfer_to INT, parent_id BIGINT, start_enquiry_id BIGINT, is_shared INT,
        is_active INT, transfer_username STRING, is_shutdown INT, is_annual INT,
        enq_type INT, file_name STRING, main_category_id INT, sub_category_id INT,
        job_start_date DATE, eff_inv_amount DECIMAL(18,4), currency STRING,
        rate DECIMAL(12,6), new_rate DECIMAL(12,6), approval_id INT,
        approval_comments STRING, client_type INT, is_msa INT, new_sub_category_id INT,
        client_agency STRING, agency_percent DOUBLE, location_country INT, offshore INT,
        enquiry_temp_id BIGINT
    """,
    "invoice": """
        debtor_no BIGINT, trans_no BIGINT, trans_type INT, tran_date DATE,
        ov_amount DECIMAL(18,4), alloc DECIMAL(18,4), rate DECIMAL(12,6),
        tax_amount DECIMAL(18,4), total_expense_aed DECIMAL(18,4), order_ BIGINT,
        payment_terms INT, dimension2_id INT, dimension_id INT, dimension3_id INT
    """,
    "credit_note": """
        trans_no BIGINT, ov_amount DECIMAL(18,4), type INT, debtor_no BIGINT,
        tran_date DATE, rate DECIMAL(12,6), order_ BIGINT, dimension2_id INT,
        dimension_id INT, dimension3_id INT, is_write_off INT
    """,
    "client_activity": _ACTIVITY.format(
        code="", tail=", enquiry_amount DECIMAL(18,4), job_amount DECIMAL(18,4)"
    ),
    "activity_code_activity": _ACTIVITY.format(code="activity_code STRING, ", tail=", status INT"),
    "job_activity": """
        id INT, name STRING, division_id INT, sub_division_id INT, activity_code STRING,
        status INT
    """,
    "enquiry_job_activity": "id BIGINT, client_enquiry_id BIGINT, activity_code STRING",
    # carried from one run to the next
    "inactive_tracking": "debtor_no BIGINT, division_id INT, last_job_date DATE, logged_at TIMESTAMP",
    "monthly_revenue": """
        division STRING, division_id INT, debtor_no BIGINT, client_name STRING, revenue DOUBLE
    """,
    "idle_clients_tracking": """
        division_id INT, client_ref BIGINT, client_id STRING, debtor_no BIGINT,
        client_name STRING,
        client_type STRING, client_status STRING, temp_client_id BIGINT,
        total_enquiry_count BIGINT, total_enquiry_amount DOUBLE,
        cancel_enquiry_count BIGINT, cancel_enquiry_amount DOUBLE,
        lost_enquiry_count BIGINT, lost_enquiry_amount DOUBLE,
        total_invoice_count BIGINT, total_invoice_amount DOUBLE
    """,
}

STATE_TABLES = ("inactive_tracking", "monthly_revenue", "idle_clients_tracking")
SOURCE_TABLES = tuple(name for name in DDL if name not in STATE_TABLES)

# Rows the extract keeps, and the column its date floor applies to.
ROW_FILTER = {"client": "inactive = 0", "dimension": "active = 1"}
FLOOR_COLUMN = {"enquiry": "enquiry_date", "invoice": "tran_date", "credit_note": "tran_date"}

# What the source calls a column, where this differs from the declaration, and the timestamps of which the
# day counts whatever the time; of others, a time of day makes the value junk.
SOURCE_NAME = {"invoice": {"trans_type": "type"}}
KEEP_DAY = {"client": ("added_date",), "dimension": ("added_date",)}

# Fact snapshots are laid out by year of this column, so date windows prune whole folders.
YEAR_OF = {**FLOOR_COLUMN, "payment_allocation": "date_alloc"}

# The columns that tell the rows of a source table apart.
KEY = {
    "client": ("debtor_no",),
    "temp_client": ("temp_clients_id",),
    "sales_order": ("order_no",),
    "sales_order_reference": ("sales_order_reference_id",),
    "payment_allocation": ("id",),
    "client_status": ("id",),
    "client_type": ("id",),
    "credit_period": ("debtor_no",),
    "country": ("id",),
    "region": ("id",),
    "dimension": ("id",),
    "enquiry": ("client_enquiry_id",),
    "invoice": ("trans_no", "trans_type"),
    "credit_note": ("trans_no", "type"),
    "client_activity": ("id",),
    "activity_code_activity": ("id",),
    "job_activity": ("id",),
    "enquiry_job_activity": ("id",),
}


def schema(table: str) -> StructType:
    """Struct type of a table; needs a running Spark context to parse the declaration."""
    return StructType.fromDDL(DDL[table])
