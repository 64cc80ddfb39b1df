"""Metric names, label map and filing-type maps."""

# The metric names a stored row may carry.
METRIC_NAMES = [
    "revenue", "ebitda", "ebit", "pat", "eps", "other_income",
    "finance_cost", "depreciation", "exceptional_items", "minority_interest",
    "total_assets", "net_worth", "cash", "total_debt", "net_debt",
    "receivables", "inventory", "payables", "working_capital",
    "operating_cash_flow", "investing_cash_flow", "financing_cash_flow",
    "capex", "free_cash_flow",
]

# Label found in a filing -> metric name.
METRIC_LABELS = {
    "revenue from operations": "revenue",
    "net revenue": "revenue",
    "total revenue": "revenue",
    "total income from operations": "revenue",
    "net sales": "revenue",
    "turnover": "revenue",
    "ebitda": "ebitda",
    "operating profit": "ebitda",
    "earnings before interest tax depreciation and amortisation": "ebitda",
    "ebit": "ebit",
    "earnings before interest and tax": "ebit",
    "profit before interest and tax": "ebit",
    "pat": "pat",
    "profit after tax": "pat",
    "profit for the period": "pat",
    "profit for the year": "pat",
    "net profit": "pat",
    "net income": "pat",
    "eps": "eps",
    "earnings per share": "eps",
    "basic eps": "eps",
    "diluted eps": "eps",
    "other income": "other_income",
    "other operating income": "other_income",
    "finance costs": "finance_cost",
    "finance cost": "finance_cost",
    "interest expense": "finance_cost",
    "interest and finance charges": "finance_cost",
    "total assets": "total_assets",
    "shareholders equity": "net_worth",
    "total equity": "net_worth",
    "net worth": "net_worth",
    "stockholders equity": "net_worth",
    "cash": "cash",
    "cash and cash equivalents": "cash",
    "cash and bank balances": "cash",
    "total debt": "total_debt",
    "borrowings": "total_debt",
    "total borrowings": "total_debt",
    "net debt": "net_debt",
    "trade receivables": "receivables",
    "receivables": "receivables",
    "debtors": "receivables",
    "inventories": "inventory",
    "inventory": "inventory",
    "trade payables": "payables",
    "payables": "payables",
    "creditors": "payables",
    "working capital": "working_capital",
    "depreciation and amortisation": "depreciation",
    "depreciation": "depreciation",
    "minority interest": "minority_interest",
    "non controlling interest": "minority_interest",
    "net cash from operating activities": "operating_cash_flow",
    "cash from operations": "operating_cash_flow",
    "operating cash flow": "operating_cash_flow",
    "net cash used in investing activities": "investing_cash_flow",
    "net cash from investing activities": "investing_cash_flow",
    "net cash used in financing activities": "financing_cash_flow",
    "net cash from financing activities": "financing_cash_flow",
    "capital expenditure": "capex",
    "capex": "capex",
    "purchase of fixed assets": "capex",
    "free cash flow": "free_cash_flow",
}

# Exchange A subject -> filing type.
EXCHANGE_A_TYPES = {
    "Financial Results": "quarterly_result",
    "Annual Report": "annual_report",
    "Shareholding Pattern": "shareholding_pattern",
    "Investor Presentation": "investor_presentation",
    "Corporate Action": "corporate_action",
    "Board Meeting": "board_meeting",
    "Insider Trading": "insider_trading",
    "Related Party Transactions": "related_party_transactions",
}

# Exchange B category -> filing type.
EXCHANGE_B_TYPES = {
    "Financial Results": "quarterly_result",
    "Annual Report": "annual_report",
    "Shareholding Pattern": "shareholding_pattern",
    "Investor Presentation": "investor_presentation",
    "Corporate Action": "corporate_action",
    "Board Meeting": "board_meeting",
    "Insider Trading / Pledge": "insider_trading",
    "Related Party Transactions": "related_party_transactions",
    "Corporate Governance": "corporate_governance",
    "BRSR": "brsr",
}

# Period prefix -> (quarter, filing type).
PERIOD_PREFIXES = {
    "Q1": (1, "quarterly_result"),
    "Q2": (2, "quarterly_result"),
    "Q3": (3, "quarterly_result"),
    "Q4": (4, "quarterly_result"),
    "H1": (2, "half_yearly_result"),
    "9M": (3, "nine_month_result"),
    "FY": (4, "annual_report"),
}

# Ticker -> exchange code.
EXCHANGE_CODES = {
    "RELIANCE": "500325",
    "TCS": "532540",
    "INFY": "500209",
    "HDFCBANK": "500180",
    "ITC": "500875",
    "LT": "500510",
    "BHARTIARTL": "532454",
    "ICICIBANK": "532174",
    "HDFC": "500010",
    "KOTAKBANK": "500247",
    "SBIN": "500112",
    "MARUTI": "532500",
    "ASIANPAINT": "500820",
    "TITAN": "500114",
}

# The item types of a company feed.
SOURCE_TYPES = [
    "annual_report", "concall", "credit_rating", "filing",
    "investor_presentation", "news",
]

# Source type -> report sections it can change.
SOURCE_SECTIONS = {
    "annual_report": [
        "business_overview", "segment_analysis", "historical_financials",
        "financial_ratios", "cash_flow_analysis", "balance_sheet_analysis",
        "receivables_analysis", "inventory_analysis", "payables_analysis",
        "working_capital_analysis", "debt_liquidity",
        "related_party_transactions", "governance_analysis",
        "auditor_analysis", "accounting_analysis", "material_risks",
        "catalysts_positives",
    ],
    "concall": [
        "management_analysis", "strategy_capital_allocation",
        "guidance_outlook", "guidance_vs_execution", "material_risks",
        "catalysts_positives", "investor_monitoring_points",
    ],
    "credit_rating": [
        "debt_liquidity", "material_risks", "financial_ratios",
        "cash_flow_analysis",
    ],
    "filing": [
        "what_changed", "material_risks", "catalysts_positives",
        "management_analysis", "governance_analysis",
    ],
    "investor_presentation": [
        "strategy_capital_allocation", "segment_analysis",
        "guidance_outlook", "management_analysis",
    ],
    "news": [
        "what_changed", "material_risks", "catalysts_positives",
        "investor_monitoring_points",
    ],
}

# The registry of known sources (name, type, tier).
SOURCE_REGISTRY = [
    ("Company Annual Report", "annual_report", 1),
    ("NSE Exchange Filing", "exchange_filing", 1),
    ("BSE Exchange Filing", "exchange_filing", 1),
    ("Statutory Auditor Report", "auditor_report", 1),
    ("SEBI Regulatory Filing", "regulatory_filing", 1),
    ("MCA/RoC Filing", "regulatory_filing", 1),
    ("NSE/BSE Shareholding Pattern", "shareholding_filing", 1),
    ("Company Investor Presentation", "investor_presentation", 2),
    ("Earnings Call Transcript", "concall_transcript", 2),
    ("Company Press Release", "company_announcement", 2),
    ("Company MD&A", "mda", 2),
    ("Credit Rating Report", "rating_report", 2),
    ("Financial Data Provider", "financial_data_provider", 3),
    ("Financial News Provider", "news_provider", 3),
    ("Other Secondary Source", "other_secondary", 4),
]

# Display label of each trust tier.
TIER_LABELS = {
    1: "Tier 1: Primary Filing",
    2: "Tier 2: Company Communication",
    3: "Tier 3: Reliable Secondary",
    4: "Tier 4: Other Secondary",
}

# Home page of the sources that have one.
SOURCE_URLS = {
    "NSE Exchange Filing": "https://www.nseindia.com",
    "BSE Exchange Filing": "https://www.bseindia.com",
    "SEBI Regulatory Filing": "https://www.sebi.gov.in",
}
