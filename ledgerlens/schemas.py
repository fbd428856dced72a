"""Declared schemas. Nothing is inferred: inference would read a '2025-03' month as a timestamp."""

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


CHUNKS = _table(
    ("id", _S),
    ("source_file", _S),
    ("file_type", _S),
    ("chunk_ord", _L),
    ("chunk_text", _S),
    ("n_tokens", _L),
)

KPI_TABLES = {
    "str_filing_kpi": _table(
        ("bank_name", _S),
        ("branch", _S),
        ("month", _S),
        ("str_filed_count", _L),
        ("avg_str_filing_days", _D),
        ("str_sla_breaches", _L),
    ),
    "ctr_reporting_kpi": _table(
        ("bank_name", _S),
        ("branch", _S),
        ("month", _S),
        ("ctrs_filed", _L),
        ("ctrs_unreported", _L),
        ("txns_above_threshold", _L),
    ),
    "kyc_edd_kpi": _table(
        ("bank_name", _S),
        ("branch", _S),
        ("month", _S),
        ("edd_completed", _L),
        ("edd_pending", _L),
        ("high_risk_customers", _L),
    ),
    "sanctions_screening_kpi": _table(
        ("bank_name", _S),
        ("branch", _S),
        ("month", _S),
        ("transactions_screened", _L),
        ("sanctions_hits_flagged", _L),
        ("sla_breaches", _L),
    ),
    "training_compliance_kpi": _table(
        ("bank_name", _S),
        ("branch", _S),
        ("quarter", _S),
        ("staff_total", _L),
        ("staff_trained_aml_cft", _L),
    ),
}

MESSAGES = T.ArrayType(_table(("role", _S), ("content", _S)))
