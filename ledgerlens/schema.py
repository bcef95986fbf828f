"""Canonical columns, header aliases and vocabularies.

Everything below the "fixed values" marker must stay exactly as written: the
values are the contract of the daily reconciliation files (file-name prefixes,
header spellings, status words, thresholds).
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# ---------------------------------------------------------------------------
# fixed values (file contract; keep as written)
# ---------------------------------------------------------------------------

# Data-set name -> file-name prefix.  The first prefix is a prefix of the
# second one, so file names are parsed with an anchored pattern.
FILE_PREFIXES = {
    "reconciled": "pvi_transaction_reconciled_",
    "taixe": "pvi_transaction_reconciled_taixe_",
}

# Cell values read as null.
NULL_TOKENS = ["", "NULL", "null"]

# Header cell that identifies a header row of either data set.
HEADER_ANCHOR = "ORDER_ID"

# Logical column -> physical header names, first hit wins.
ALIASES = {
    "order_id": ["ORDER_ID"],
    "merchant": ["MERCHANT"],
    "amount": ["TOTAL_AMOUNT", "AMOUNT"],
    "order_time": ["ORDER_TIME"],
    "created_time": ["CREATED_TIME"],
    "reconcile_status": ["RECONCILE_STATUS", "Reconcile Status", "RECONCILE STATUS", "RECONCILE",
                         "GSM_ORDER_RECONCILE", "GSM_ORDE_RECONCILE", "RECONCILE_STAT"],
    "insurance_status": ["INSURANCE_STATUS"],
    "is_business_order": ["IS_BUSINESS_ORDER"],
    "service_type": ["SERVICE_TYPE"],
    "gsm_amount": ["GSM Amount", "GSM_AMOUNT", "GSM_AMO", "GSM_AMOUNT_MERCHANT", "GSM_AMO_MERCHANT",
                   "GSM_AMOUNT_MERCH", "GSM_AMO_MERCH"],
    "merchant_amount": ["Merchant Amount", "MERCHANT_AMOUNT"],
    "pvi_amount": ["PVI_AMOUNT"],
    "reconciled_amount": ["RECONCILED_AMOUNT", "RECONCILE_AMOUNT"],
    "gsm_status": ["GSM_STATUS"],
    "merchant_status": ["Merchant Status", "MERCHANT_STATUS", "GSM_STATUS_MERCHANT", "GSM_STATU_MERCHANT",
                        "MERCHANT_STAT", "MERCH_STATUS"],
}

# The driver-order file lists the spaced spelling of the status first.
DRIVER_ALIASES = dict(ALIASES)
DRIVER_ALIASES["reconcile_status"] = ["Reconcile Status", "RECONCILE STATUS", "RECONCILE_STATUS", "RECONCILE",
                                      "GSM_ORDER_RECONCILE", "GSM_ORDE_RECONCILE", "RECONCILE_STAT"]

# Reconcile status words.
STATUS_MATCH = "match"
STATUS_ONLY_M = "not_found_in_m"            # present in the insurer ledger only
STATUS_ONLY_EXTERNAL = "not_found_in_external"  # present in the platform ledger only
STATUS_NOT_FOUND = "not_found"

# Status -> description (English codes; translation is a presentation concern).
STATUS_DESCRIPTIONS = [
    ("match", "matched on both sides"),
    ("not_found_in_m", "insurer side only (missing on platform)"),
    ("not_found_in_external", "platform side only (missing on insurer)"),
    ("completed", "completed"),
    ("cancelled", "cancelled"),
    ("pending", "pending"),
]

# Service-type labels.
SERVICE_NORMAL_RAW = "normal"
SERVICE_EXPRESS_RAW = "express"
SERVICE_NORMAL_LABEL = "Ride (Normal)"
SERVICE_EXPRESS_LABEL = "Express"
SERVICE_UNKNOWN_LABEL = "unknown"

# Business-flag labels.
BUSINESS_TRUE_TOKENS = ["true", "1", "yes"]
BUSINESS_FALSE_TOKENS = ["false", "0", "no"]
BUSINESS_LABEL = "Business"
NON_BUSINESS_LABEL = "Non-Business"
UNKNOWN_LABEL = "Unknown"

# Vehicle class from the platform amount.
VEHICLE_BIKE_AMOUNT = 100
VEHICLE_CAR_AMOUNT = 200
VEHICLE_BIKE = "Bike"
VEHICLE_CAR = "Car"
VEHICLE_OTHER = "other"

# Merchant-status severity words (case-insensitive substrings).
SEVERITY_BAD_WORDS = ["fail", "error"]
SEVERITY_GOOD_WORDS = ["success", "match"]

# Thresholds.
LARGE_FILE_MB = 40.0
HIGH_DISCREPANCY_RATIO = 0.1
UNUSUAL_MERCHANT_RATE = 20.0
REVIEW_MERCHANT_RATE = 15.0
LOW_MATCH_RATE = 80.0
ONE_SIDED_SHARE = 0.05
ORDER_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Columns shown first in detail views, in this order; all others follow.
PRIORITY_COLUMNS = ["order_id", "merchant", "amount", "service_type", "reconcile_status",
                    "insurance_status", "is_business_order", "order_time", "created_time"]

# Versions of a day's file: the base file and its re-issue.
FILE_VERSIONS = (1, 2)

# The shape of ORDER_TIME_FORMAT as a pattern.
ORDER_TIME_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"

# ---------------------------------------------------------------------------
# canonical silver schema
# ---------------------------------------------------------------------------

# Logical column -> Spark type of the typed table.  Columns not listed stay strings.
CANONICAL_TYPES = {
    "order_id": T.StringType(),
    "merchant": T.StringType(),
    "amount": MONEY,
    "order_time": T.TimestampNTZType(),
    "created_time": T.TimestampNTZType(),
    "reconcile_status": T.StringType(),
    "insurance_status": T.StringType(),
    "is_business_order": T.StringType(),
    "service_type": T.StringType(),
    "gsm_amount": MONEY,
    "merchant_amount": MONEY,
    "pvi_amount": MONEY,
    "reconciled_amount": MONEY,
    "gsm_status": T.StringType(),
    "merchant_status": T.StringType(),
}

TRANSACTION_COLUMNS = ["order_id", "merchant", "amount", "order_time", "reconcile_status",
                       "insurance_status", "is_business_order", "service_type", "gsm_amount",
                       "merchant_amount", "pvi_amount", "reconciled_amount", "created_time"]

DRIVER_COLUMNS = ["order_id", "reconcile_status", "gsm_amount", "merchant_amount",
                  "reconciled_amount", "gsm_status", "merchant_status", "merchant", "amount", "order_time"]
