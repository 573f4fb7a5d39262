"""Databases to run statements on, the built-in schema, and configuration files."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The built-in schema, a table per line: name, then column:type, * for the primary key, > for a foreign key's target.
BUILT_IN_DB = "subscription_analytics"
BUILT_IN_SCHEMA = """
customers: customer_id:INTEGER* first_name:TEXT last_name:TEXT email:TEXT company_name:TEXT country:TEXT created_at:TIMESTAMP
plans: plan_id:INTEGER* plan_name:TEXT tier:TEXT monthly_fee_usd:REAL max_users:INTEGER
subscriptions: subscription_id:INTEGER* customer_id:INTEGER>customers.customer_id plan_id:INTEGER>plans.plan_id status:TEXT start_date:DATE end_date:DATE auto_renew:BOOLEAN
invoices: invoice_id:INTEGER* subscription_id:INTEGER>subscriptions.subscription_id amount_due_usd:REAL discount_amount_usd:REAL issue_date:DATE due_date:DATE paid_date:DATE status:TEXT
transactions: transaction_id:INTEGER* invoice_id:INTEGER>invoices.invoice_id payment_gateway:TEXT amount_paid_usd:REAL transaction_date:TIMESTAMP success:BOOLEAN
support_tickets: ticket_id:INTEGER* customer_id:INTEGER>customers.customer_id priority:TEXT category:TEXT created_at:TIMESTAMP resolved_at:TIMESTAMP satisfaction_score:INTEGER
"""

COLUMNS = "db_id string, table_no int, table_name string, column_no int, column_name string, data_type string, is_primary_key boolean, foreign_table string, foreign_column string"


def built_in_columns(spark: SparkSession) -> DataFrame:
    """The built-in schema as ``schema_columns`` gives it."""
    rows, number = [], 0
    for table_no, line in enumerate(BUILT_IN_SCHEMA.strip().split("\n")):
        table, _, columns = line.partition(": ")
        for column in columns.split():
            number += 1
            name, _, kind = column.partition(":")
            kind, _, target = kind.partition(">")
            foreign = target.split(".") if target else [None, None]
            rows.append((BUILT_IN_DB, table_no, table, number, name, kind.rstrip("*"), kind.endswith("*"), *foreign))
    return spark.createDataFrame(rows, COLUMNS)


def database_folder(db_id: str, roots: list[str]) -> str | None:
    """The first folder of Parquet tables for a database among ``root/db_id`` and ``root/database/db_id``."""
    for root in roots:
        for folder in (os.path.join(root, db_id), os.path.join(root, "database", db_id)):
            if os.path.isdir(folder):
                return folder
    return None


def register_database(spark: SparkSession, folder: str) -> list[str]:
    """Register every ``<name>.parquet`` of a folder as a view and return the names."""
    names = sorted(f.removesuffix(".parquet") for f in os.listdir(folder) if f.endswith(".parquet"))
    for name in names:
        spark.read.parquet(os.path.join(folder, f"{name}.parquet")).createOrReplaceTempView(name)
    return names


def load_config(path: str) -> dict[str, Any]:
    """A YAML or JSON file that must hold a mapping."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml package") from e
        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return data
