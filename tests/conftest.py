import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]
from panelyard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("*", 4, "panelyard-tests")


@pytest.fixture(scope="session")
def panel_pdf():
    """Seeded random walks: 12 codes over 90 business days, some rows missing."""
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2024-01-01", periods=90)
    parts = []
    for i in range(12):
        close = np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days)))), 2)
        spread = rng.uniform(0.1, 1.0, len(days))
        part = pd.DataFrame({"code": f"{i:06d}.SH", "date": days.date, "open": close + rng.normal(0, 0.3, len(days)),
                             "high": close + spread, "low": close - spread, "close": close,
                             "volume": rng.integers(100, 5000, len(days)).astype(float)})
        parts.append(part.sample(frac=0.95, random_state=i).sort_values("date"))
    out = pd.concat(parts, ignore_index=True)
    out["amount"] = out["close"] * out["volume"]
    out["turnover_rate"] = out["volume"] / 100
    return out


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    return spark.createDataFrame(panel_pdf).persist()


def to_pandas(df, *order):
    out = df.toPandas()
    return out.sort_values(list(order)).reset_index(drop=True) if order else out
