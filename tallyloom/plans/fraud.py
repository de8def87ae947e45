"""Net worth and transaction figures by age bucket and fraud label."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.scalars import bucketise, total
from tallyloom.operators.joins import join_derived_dimension, with_derived_label

# The bucket borders and their names. The first bucket takes every lower age as well.
AGE_BOUNDS = [30, 45, 60]
AGE_LABELS = ["18-29", "30-44", "45-59", "60+"]

# The balances that count as assets and as liabilities.
ASSETS = ["bank_account_balance", "sec_bank_account_balance", "savings_account_balance", "sec_savings_account_balance"]
LIABILITIES = ["credit_card_balance", "mortgage_balance", "primary_loan_balance", "secondary_loan_balance", "uni_loan_balance"]


@dataclass(frozen=True)
class Columns:
    """Which columns of a table play the parts of the job."""

    key: str = "age"
    label: str = "fraud_trx"
    amount: str = "transaction_amount"
    bounds: Sequence[float] = field(default_factory=lambda: AGE_BOUNDS)
    labels: Sequence[str] = field(default_factory=lambda: AGE_LABELS)
    bucket: str = "age_bucket"


BANKING = Columns()


def add_net_worth(df: DataFrame, assets: Sequence = ASSETS, liabilities: Sequence = LIABILITIES) -> DataFrame:
    return df.withColumns({"total_assets": total(*assets), "total_liabilities": total(*liabilities)}).withColumn(
        "net_worth", F.col("total_assets") - F.col("total_liabilities")
    )


def bucketed(features: DataFrame, columns: Columns = BANKING, join: bool = False) -> DataFrame:
    """Rows with their bucket. ``join=True`` goes through the stored dimension table instead of
    evaluating the bucket in place; both drop rows without a key."""
    label = bucketise(columns.key, columns.bounds, columns.labels)
    add = join_derived_dimension if join else with_derived_label
    return add(features, columns.key, label, columns.bucket)


def fraud_metrics(features: DataFrame, columns: Columns = BANKING, join: bool = False) -> DataFrame:
    """Count, total, mean and sample deviation of the amounts and mean net worth per bucket and label."""
    return (
        bucketed(features, columns, join)
        .groupBy(columns.bucket, columns.label)
        .agg(
            F.count("*").alias("txn_count"),
            F.sum(columns.amount).alias("total_trx_amount"),
            F.avg(columns.amount).alias("avg_trx_amount"),
            F.avg("net_worth").alias("avg_net_worth"),
            F.stddev_samp(columns.amount).alias("trx_stddev"),
        )
    )


def final_summary(metrics: DataFrame, label: str = "fraud_trx") -> DataFrame:
    """Totals per label. The net worth is the plain mean of the bucket means: every bucket counts alike."""
    return metrics.groupBy(label).agg(
        F.sum("txn_count").alias("total_txns"),
        F.sum("total_trx_amount").alias("total_amount"),
        F.avg("avg_net_worth").alias("overall_avg_net_worth"),
    )


def banking_summary(transactions: DataFrame, join: bool = False) -> DataFrame:
    return final_summary(fraud_metrics(add_net_worth(transactions), join=join))
