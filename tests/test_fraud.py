import math
import statistics

import pytest

from tallyloom.plans import fraud
from tallyloom.sinks.writers import plan_text
from tallyloom.sources.datagen import BANKING_FEATURES

AGES = [12.0, 29.0, 30.0, 44.0, 45.0, 59.0, 60.0, 100.0, None, 29.0, 30.0]


@pytest.fixture(scope="module")
def transactions(spark):
    data = []
    for i, age in enumerate(AGES):
        row = {c: float(100 + 10 * i + k) for k, c in enumerate(BANKING_FEATURES)}
        row["age"], row["fraud_trx"] = age, i % 2
        data.append(tuple(row[c] for c in [*BANKING_FEATURES, "fraud_trx"]))
    schema = ", ".join(f"{c} float" for c in BANKING_FEATURES) + ", fraud_trx int"
    return spark.createDataFrame(data, schema)


def expected_metrics(records):
    groups = {}
    for r in records:
        if r["age"] is None:
            continue
        bucket = "18-29" if r["age"] < 30 else "30-44" if r["age"] < 45 else "45-59" if r["age"] < 60 else "60+"
        worth = sum(r[c] for c in fraud.ASSETS) - sum(r[c] for c in fraud.LIABILITIES)
        groups.setdefault((bucket, r["fraud_trx"]), []).append((r["transaction_amount"], worth))
    return {
        k: (len(v), sum(a for a, _ in v), statistics.mean(a for a, _ in v), statistics.mean(w for _, w in v),
            statistics.stdev([a for a, _ in v]) if len(v) > 1 else None)
        for k, v in groups.items()
    }


@pytest.mark.parametrize("join", [False, True])
def test_metrics(transactions, join):
    got = fraud.fraud_metrics(fraud.add_net_worth(transactions), join=join)
    assert got.columns == ["age_bucket", "fraud_trx", "txn_count", "total_trx_amount", "avg_trx_amount", "avg_net_worth", "trx_stddev"]
    want = expected_metrics([r.asDict() for r in transactions.collect()])
    found = {(r[0], r[1]): tuple(r)[2:] for r in got.collect()}
    assert found.keys() == want.keys()
    for key, values in want.items():
        for a, b in zip(found[key], values):
            assert a == b or math.isclose(a, b, rel_tol=1e-9)
    assert any(v[-1] is None for v in found.values())


def test_summary_is_the_plain_mean_of_bucket_means(transactions):
    metrics = fraud.fraud_metrics(fraud.add_net_worth(transactions)).collect()
    for row in fraud.banking_summary(transactions).collect():
        mine = [m for m in metrics if m["fraud_trx"] == row["fraud_trx"]]
        assert row["total_txns"] == sum(m["txn_count"] for m in mine)
        assert math.isclose(row["total_amount"], sum(m["total_trx_amount"] for m in mine))
        assert math.isclose(row["overall_avg_net_worth"], statistics.mean(m["avg_net_worth"] for m in mine))


def test_unused_aggregates_are_pruned(transactions):
    plan = plan_text(fraud.banking_summary(transactions))
    assert "stddev" not in plan and "Join" not in plan


def test_float_columns_stay_float(transactions):
    types = dict(fraud.add_net_worth(transactions).dtypes)
    assert types["total_assets"] == types["total_liabilities"] == types["net_worth"] == "float"
