"""Factor metadata, and computing factor categories whose inputs exist."""

from . import factors as FA, fundamentals as FU
from .smoothing import TECHNICAL, add_recursive

# Factor -> (category, direction, presentation, analysis, compared within industry).
FACTOR_META = {
    "reversal_5d": ("momentum", -1, "metric_grid", "threshold", False),
    "reversal_20d": ("momentum", -1, "metric_grid", "threshold", False),
    "lncap": ("size", 0, "metric_grid", "threshold", False),
    "turnover_20d": ("liquidity", 0, "metric_grid", "threshold", False),
    "turnover_change": ("liquidity", 0, "metric_grid", "trend", False),
    "volatility_20d": ("volatility", -1, "metric_grid", "threshold", False),
    "volume_20d": ("volume", 0, "metric_grid", "threshold", False),
    "volume_ratio": ("volume", 0, "metric_grid", "threshold", False),
    "money_flow_20d": ("money_flow", 1, "metric_grid", "direction", False),
    "macd_dif": ("technical", 1, "indicator_panel", "signal", False),
    "macd_dea": ("technical", 1, "indicator_panel", "signal", False),
    "macd_hist": ("technical", 1, "indicator_panel", "signal", False),
    "rsi_14": ("technical", 0, "indicator_panel", "signal", False),
    "kdj_k": ("technical", 0, "indicator_panel", "signal", False),
    "kdj_d": ("technical", 0, "indicator_panel", "signal", False),
    "kdj_j": ("technical", 0, "indicator_panel", "signal", False),
    "boll_ub": ("technical", 0, "band_chart", "threshold", False),
    "boll_mid": ("technical", 0, "band_chart", "threshold", False),
    "boll_lb": ("technical", 0, "band_chart", "threshold", False),
    "ma5": ("technical", 1, "indicator_panel", "signal", False),
    "ma10": ("technical", 1, "indicator_panel", "signal", False),
    "ma20": ("technical", 1, "indicator_panel", "signal", False),
    "ma60": ("technical", 1, "indicator_panel", "signal", False),
    "wr": ("technical", 0, "indicator_panel", "signal", False),
    "cci": ("technical", 0, "indicator_panel", "signal", False),
    "obv": ("technical", 1, "indicator_panel", "direction", False),
    "roe_ttm": ("financial", 1, "metric_grid", "industry_compare", True),
    "roa_ttm": ("financial", 1, "metric_grid", "industry_compare", True),
    "gross_margin_ttm": ("financial", 1, "metric_grid", "industry_compare", True),
    "net_margin_ttm": ("financial", 1, "metric_grid", "industry_compare", True),
    "revenue_growth_yoy": ("growth", 1, "trend_chart", "trend", False),
    "profit_growth_yoy": ("growth", 1, "trend_chart", "trend", False),
    "debt_ratio": ("financial", -1, "metric_grid", "threshold", False),
    "current_ratio": ("financial", 1, "metric_grid", "threshold", False),
    "ocf": ("financial", 1, "metric_grid", "direction", False),
    "pe_ttm": ("valuation", -1, "percentile_chart", "percentile", False),
    "pb": ("valuation", -1, "percentile_chart", "percentile", False),
    "ps_ttm": ("valuation", -1, "percentile_chart", "percentile", False),
    "dv_ratio": ("valuation", 1, "metric_grid", "threshold", False),
    "pe_percentile": ("valuation", -1, "percentile_chart", "percentile", False),
    "pb_percentile": ("valuation", -1, "percentile_chart", "percentile", False),
    "main_net_inflow": ("capital_flow", 1, "flow_table", "direction", False),
    "main_net_inflow_5d": ("capital_flow", 1, "flow_table", "direction", False),
    "north_net_inflow": ("capital_flow", 1, "flow_table", "direction", False),
    "lhb_count_5d": ("dragon_tiger", 1, "event_list", "event", False),
    "lhb_net_buy": ("dragon_tiger", 1, "event_list", "event", False),
    "top_holder_change": ("shareholder", 0, "holder_table", "change", False),
    "holder_concentration": ("shareholder", 0, "holder_table", "change", False),
    "alpha_score": ("composite", 1, "metric_grid", "threshold", False),
}


def factor_meta(spark):
    """The metadata as a small DataFrame."""
    return spark.createDataFrame([(k, *v) for k, v in FACTOR_META.items()],
                                 "factor string, category string, direction int, presentation string, analysis string, industry_compare boolean")


def factors_of(category):
    return [f for f, (c, *_) in FACTOR_META.items() if c == category]


def _technical(df, tables):
    return add_recursive(FA.technical_factors(df), TECHNICAL)


def _financial(df, tables):
    return FU.financial_factors(df, tables["financial"]).drop("report_period")


# Category -> (side table it needs or None, function).
CATEGORIES = {
    "price_volume": (None, lambda df, t: FA.panel_factors(df)),
    "technical": (None, _technical),
    "financial": ("financial", _financial),
    "capital_flow": ("capital_flow", lambda df, t: FU.capital_flow_factors(df, t["capital_flow"])),
    "valuation": ("valuation", lambda df, t: FU.valuation_percentile_factors(df, t["valuation"])),
    "dragon_tiger": ("top_list", lambda df, t: FU.top_list_factors(df, t["top_list"])),
    "shareholder": ("shareholder", lambda df, t: FU.holder_factors(df, t["shareholder"])),
}


def compute_categories(panel, tables=None, enabled=tuple(CATEGORIES)):
    """One lazy plan with the enabled categories whose side table is given.

    Returns (DataFrame, computed names, skipped name -> reason).
    """
    tables = tables or {}
    computed, skipped, out = [], {}, panel
    for name in enabled:
        if name not in CATEGORIES:
            raise ValueError(f"unknown category {name}")
        need, fn = CATEGORIES[name]
        if need and tables.get(need) is None:
            skipped[name] = f"no {need} table"
            continue
        out = fn(out, tables)
        computed.append(name)
    return out, computed, skipped
