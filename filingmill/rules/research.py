"""Research catalogues: sections, retrieval queries, scopes, cross-checks."""

# Retrieval sections in report order.
SECTIONS = [
    "business", "segments", "financial", "financial_trends", "ratios",
    "cash_balance_sheet", "cash_flow", "balance_sheet", "receivables",
    "inventory", "payables", "working_capital", "debt", "management",
    "outlook", "industry", "related_parties", "governance", "shareholders",
    "subsidiaries", "risks", "positives",
]

# Section titles.
SECTION_TITLES = {
    "business": "Business",
    "segments": "Segment Analysis",
    "financial": "Financial Performance",
    "financial_trends": "Five-Year Financial Trends",
    "ratios": "Financial Ratios",
    "cash_balance_sheet": "Cash Flow & Balance Sheet",
    "cash_flow": "Cash Flow",
    "balance_sheet": "Balance Sheet",
    "receivables": "Receivables",
    "inventory": "Inventory",
    "payables": "Payables",
    "working_capital": "Working Capital",
    "debt": "Debt & Liquidity",
    "management": "Management & Strategy",
    "outlook": "Outlook & Guidance",
    "industry": "Industry Context",
    "related_parties": "Related-Party Transactions",
    "governance": "Governance & Auditor",
    "shareholders": "Shareholders & Ownership",
    "subsidiaries": "Subsidiaries / JVs",
    "risks": "Risks",
    "positives": "Positive Developments",
}

# Retrieval queries of each section, in order.
SECTION_QUERIES = {
    "business": [
        "EBITDA of Oil to Chemicals",
        "Retail Segment recorded a Gross Revenue",
        "Revenue and EBITDA growth for the Digital Services business",
        "Oil and Gas EBITDA",
        "Management Discussion and Analysis Business Overview",
        "new energy systems", "segment revenue", "segment results",
    ],
    "segments": [
        "Segment Revenue External Turnover",
        "Segment Result before Interest and Taxes",
        "Total Value of Sales and Services after elimination of inter segment turnover",
        "segment revenue", "segment results", "Oil to Chemicals",
        "Oil and Gas", "Retail", "Digital Services", "Financial Services",
        "segment assets",
    ],
    "financial": [
        "10-Year Financial Highlights",
        "Value of Sales and Services Revenue",
        "Earnings Before Depreciation Finance Cost and Tax Expenses",
        "Profit for the Year", "consolidated statement of profit and loss",
        "earnings per share", "Consolidated revenue grew",
    ],
    "financial_trends": [
        "10-Year Financial Highlights", "Value of Sales and Services",
        "Earnings Before Depreciation Finance Cost and Tax Expenses",
        "Profit for the Year", "Net Fixed Assets", "Consolidated",
    ],
    "ratios": [
        "Current Ratio", "Debt-Equity Ratio", "Debt:Equity Ratio",
        "EBITDA/Gross Turnover", "Net Profit Margin", "Return on Net Worth",
        "ROCE",
    ],
    "cash_balance_sheet": [
        "consolidated statement of cash flows",
        "Cash Generated from Operations",
        "Net Cash Flow from Operating Activities",
        "Net Cash Flow from Investing Activities",
        "Net Increase in Cash and Cash Equivalents", "capital expenditure",
        "Consolidated Net Debt",
        "Cash and Cash Equivalents as per Balance Sheet",
        "Borrowings Non-Current", "working capital",
    ],
    "cash_flow": [
        "consolidated statement of cash flows",
        "Net Cash Flow from Operating Activities",
        "Net Cash Flow from Investing Activities",
        "Net Cash Flow from Financing Activities",
        "Net Increase in Cash and Cash Equivalents", "capital expenditure",
    ],
    "balance_sheet": [
        "consolidated balance sheet", "total assets", "total equity",
        "current assets", "current liabilities",
        "Cash and Cash Equivalents as per Balance Sheet", "Net Fixed Assets",
    ],
    "receivables": [
        "Trade Receivables 8", "trade receivables", "receivables",
        "expected credit loss", "ageing schedule", "credit risk",
    ],
    "inventory": [
        "Inventories 6", "inventories", "inventory", "raw materials",
        "stock in trade", "inventory valuation",
    ],
    "payables": [
        "Trade Payables Due to Micro and Small Enterprises",
        "trade payables", "payables", "micro small and medium enterprises",
        "supplier", "creditors",
    ],
    "working_capital": [
        "Operating Profit before Working Capital Changes Inventories",
        "working capital", "trade receivables", "inventories",
        "trade payables", "current assets", "current liabilities",
        "current ratio",
    ],
    "debt": [
        "Consolidated Net Debt", "borrowings", "Debt-Equity Ratio",
        "Debt:Equity Ratio", "finance cost", "interest coverage",
        "foreign currency borrowings",
    ],
    "management": [
        "chairman's statement", "strategic priorities", "capital allocation",
        "investment priorities", "target", "guidance", "outlook",
    ],
    "outlook": [
        "FY 2026-27 outlook remains", "outlook", "strategic priorities",
        "growth opportunities", "new energy", "investment priorities",
        "target", "guidance",
    ],
    "industry": [
        "Global economic expansion continued", "Operating Environment",
        "market demand", "industry", "commodity prices", "regulatory",
        "competition", "digital services", "retail",
    ],
    "related_parties": [
        "related party disclosures", "related party transactions",
        "key management personnel", "loans and advances", "guarantees",
        "receivables", "commercial rationale",
    ],
    "governance": [
        "independent auditor's report", "key audit matters",
        "emphasis of matter", "qualified opinion",
        "internal financial controls", "auditor", "accounting policy",
    ],
    "shareholders": [
        "shareholding pattern", "promoter and promoter group", "pledged",
        "equity shares", "major shareholders", "dilution",
        "beneficial owner",
    ],
    "subsidiaries": [
        "material subsidiaries",
        "subsidiaries associates and joint ventures", "joint ventures",
        "associate companies", "financial information of subsidiaries",
        "investments in subsidiaries", "non-controlling interests",
    ],
    "risks": [
        "risk management", "principal risks", "contingent liabilities",
        "litigation", "impairment", "cyber security",
        "commodity price risk", "regulatory risk",
    ],
    "positives": [
        "growth", "commissioned", "launched", "expanded", "record",
        "milestone", "operational performance", "market leadership",
    ],
}

# Sections whose chunk selection starts from basis statements.
BASIS_SECTIONS = [
    "financial", "financial_trends", "ratios", "cash_balance_sheet",
    "cash_flow", "balance_sheet", "receivables", "inventory", "payables",
    "working_capital", "debt", "segments",
]
BASIS_QUERIES = [
    "consolidated financial statements", "standalone financial statements",
]

# Scope of each section as (alternatives, whole word).
# A whole-word scope must end at a word boundary; the others may run on.
SECTION_SCOPE = {
    "business": (r"segment|business|retail|digital services|jio|oil to chemicals|o2c|oil and gas|new energy|operations?", True),
    "segments": (r"segment|oil to chemicals|o2c|oil and gas|retail|digital services|financial services|media|segment revenue|segment result|inter.?segment", True),
    "financial": (r"revenue|income|ebitda|profit|pat|margin|eps|tax|expense|earnings", True),
    "financial_trends": (r"five.?year|ten.?year|trend|revenue|ebitda|profit|fixed assets|financial highlights|grew|increased|declined", True),
    "ratios": (r"ratio|margin|roce|ronw|return on|debt.?equity|current ratio|interest coverage|turnover", True),
    "cash_balance_sheet": (r"cash|capex|capital expenditure|debt|borrow|liquid|working capital|balance sheet|asset|liabilit|inventory|receivable|payable|free cash|net debt", False),
    "cash_flow": (r"cash flow|operating cash|investing cash|financing cash|capex|capital expenditure|free cash|cash equivalent", False),
    "balance_sheet": (r"balance sheet|asset|liabilit|equity|cash and cash|fixed asset|current asset|current liabilit|liquidity", False),
    "receivables": (r"receivable|expected credit loss|ageing|collection|credit risk", False),
    "inventory": (r"inventor|stock in trade|raw material|obsolescence|valuation", False),
    "payables": (r"payable|supplier|creditor|msme|micro small", False),
    "working_capital": (r"working capital|current asset|current liabilit|receivable|inventor|payable|current ratio", False),
    "debt": (r"debt|net debt|borrow|finance cost|interest|maturity|currency", False),
    "management": (r"management|strategy|strategic|plan|target|guidance|priority|capital allocation|commission|capacity|new energy|technology|transition|investment", False),
    "outlook": (r"outlook|guidance|target|plan|priority|expected|growth opportunity|investment|new energy", False),
    "industry": (r"industry|market|demand|price|commodity|competition|regulatory|operating environment|macro", False),
    "related_parties": (r"related part|arm.?s length|audit committee approval|material related|rpt", False),
    "governance": (r"auditor|audit|internal control|qualification|adverse|misstatement|accounting|governance|compliance|opinion|key audit", False),
    "shareholders": (r"shareholder|promoter|shareholding|pledge|ownership|institutional|public shareholder|dilution|bonus share|paid-up capital|shares held", False),
    "subsidiaries": (r"subsidiar|associate|joint venture|jv(?![A-Za-z0-9_])|jio platforms|reliance jio|reliance retail ventures|material entit", False),
    "risks": (r"risk|proceeding|litigation|arbitration|exposure|judgement|estimate|contingent|uncertain|vulnerab|adverse|dispute", False),
    "positives": (r"grew|growth|increase|improv|record|achiev|strength|expand|benefit|launch|commission|complet", False),
}

# Retrieval section -> research-check categories.
SECTION_CHECK_CATEGORIES = {
    "business": ["consolidated", "long_term"],
    "segments": ["consolidated", "long_term"],
    "financial": ["accounting", "consolidated", "shareholder_economics"],
    "financial_trends": ["accounting", "consolidated", "long_term"],
    "ratios": ["accounting", "consolidated", "capital_allocation"],
    "cash_balance_sheet": ["capital_allocation", "consolidated", "contingent_liabilities"],
    "cash_flow": ["capital_allocation", "consolidated", "contingent_liabilities"],
    "balance_sheet": ["capital_allocation", "consolidated", "contingent_liabilities"],
    "receivables": ["accounting", "consolidated"],
    "inventory": ["accounting", "consolidated"],
    "payables": ["accounting", "consolidated"],
    "working_capital": ["accounting", "consolidated", "capital_allocation"],
    "debt": ["consolidated", "capital_allocation", "contingent_liabilities"],
    "management": ["management", "capital_allocation"],
    "outlook": ["management", "capital_allocation", "long_term"],
    "industry": ["long_term"],
    "related_parties": ["consolidated", "capital_allocation"],
    "governance": ["auditor", "accounting"],
    "shareholders": ["shareholder_economics"],
    "subsidiaries": ["consolidated", "capital_allocation"],
    "risks": ["contingent_liabilities", "accounting", "long_term"],
    "positives": ["capital_allocation", "long_term"],
}

# Retrieval section -> framework sections.
FRAMEWORK_SECTIONS = {
    "business": ["business"],
    "segments": ["business"],
    "financial": ["financial"],
    "financial_trends": ["financial"],
    "ratios": ["financial", "balance_sheet"],
    "cash_balance_sheet": ["cash_flow", "balance_sheet"],
    "cash_flow": ["cash_flow"],
    "balance_sheet": ["balance_sheet"],
    "receivables": ["balance_sheet"],
    "inventory": ["balance_sheet"],
    "payables": ["balance_sheet"],
    "working_capital": ["cash_flow", "balance_sheet"],
    "debt": ["balance_sheet"],
    "management": ["management"],
    "outlook": ["outlook"],
    "industry": ["industry"],
    "related_parties": ["related_parties"],
    "governance": ["governance"],
    "shareholders": ["shareholders"],
    "subsidiaries": ["business"],
    "risks": ["red_flags"],
    "positives": ["positives"],
}

# Universal research checks (key, category).
RESEARCH_CHECKS = [
    ("accounting_policy_changes", "accounting"),
    ("exceptional_items_quality", "accounting"),
    ("other_income_quality", "accounting"),
    ("auditor_change", "auditor"),
    ("restatements", "auditor"),
    ("internal_control_weaknesses", "auditor"),
    ("fraud_whistleblower", "auditor"),
    ("minority_interest_quality", "consolidated"),
    ("subsidiary_earnings_drivers", "consolidated"),
    ("subsidiary_capital_consumption", "consolidated"),
    ("incremental_roce", "capital_allocation"),
    ("acquisition_value", "capital_allocation"),
    ("retained_cash_deployment", "capital_allocation"),
    ("share_count_dilution", "shareholder_economics"),
    ("eps_vs_pat", "shareholder_economics"),
    ("management_explanation_consistency", "management"),
    ("management_failure_transparency", "management"),
    ("management_remuneration_alignment", "management"),
    ("contingent_liability_materiality", "contingent_liabilities"),
    ("contingent_liability_crystallisation", "contingent_liabilities"),
    ("incremental_roic_trajectory", "long_term"),
    ("competitive_advantage_trajectory", "long_term"),
    ("thesis_invalidation_evidence", "long_term"),
]

# Cross-check rules (framework, rule, metric a, metric b).
CROSS_CHECK_RULES = [
    ("default", "pl_vs_cashflow", "pat", "operating_cash"),
    ("default", "revenue_vs_receivables", "revenue_growth", "receivables_growth"),
    ("default", "profit_vs_cashflow", "ebitda", "operating_cash"),
    ("default", "debt_vs_interest", "debt", "interest_expense"),
    ("default", "capex_vs_depreciation", "capex", "depreciation"),
    ("default", "mgmt_guidance_vs_result", "guided_metric", "actual_metric"),
    ("default", "eps_vs_pat_growth", "eps_growth", "pat_growth"),
    ("default", "other_income_vs_pat", "other_income", "pat"),
    ("default", "exceptional_vs_pat", "exceptional_items", "pat"),
    ("bank", "npa_vs_provisions", "gnpa", "provision_coverage"),
    ("bank", "nim_vs_credit_cost", "nim", "credit_cost"),
    ("bank", "slippage_vs_mgmt_guidance", "slippage_ratio", "guided_slippage"),
    ("bank", "cd_ratio_trend", "credit_growth", "deposit_growth"),
    ("epc", "revenue_vs_receivables", "revenue_growth", "receivables_growth"),
    ("epc", "profit_vs_cashflow", "pat", "operating_cash"),
    ("epc", "order_book_vs_revenue", "order_book", "revenue"),
    ("epc", "mgmt_margin_guidance", "guided_margin", "actual_margin"),
    ("manufacturing", "volume_vs_revenue", "volume_growth", "revenue_growth"),
    ("manufacturing", "inventory_vs_sales", "inventory_growth", "revenue_growth"),
    ("manufacturing", "capex_vs_utilisation", "capex", "utilisation_pct"),
    ("manufacturing", "margin_vs_input_cost", "ebitda_margin", "rm_cost_pct"),
    ("it_services", "revenue_vs_headcount", "revenue_growth", "headcount_growth"),
    ("it_services", "dso_vs_revenue", "dso", "revenue_growth"),
    ("it_services", "deal_wins_vs_revenue", "deal_tcv", "revenue_growth"),
    ("it_services", "mgmt_margin_guidance", "guided_margin", "actual_margin"),
    ("conglomerate", "segment_cash_vs_group_debt", "operating_cash", "net_debt_change"),
    ("conglomerate", "capex_vs_returns", "capex", "roce_by_segment"),
    ("conglomerate", "related_party_scale", "rpt_value", "revenue"),
]

# Key metrics of each framework.
KEY_METRICS = {
    "default": [
        "revenue_growth", "ebitda_margin", "pat_margin", "operating_cash",
        "fcf", "debt_equity", "interest_coverage", "roce",
    ],
    "bank": [
        "nim", "gnpa", "nnpa", "provision_coverage", "casa_ratio",
        "credit_growth", "cd_ratio", "car", "roa", "roe", "slippage_ratio",
        "pb_ratio",
    ],
    "epc": [
        "order_book", "book_to_bill", "order_inflow", "ebitda_margin",
        "roce", "debtor_days", "unbilled_revenue", "cash_conversion",
        "net_debt", "promoter_pledge",
    ],
    "manufacturing": [
        "capacity_utilisation", "volume_growth", "realisation_per_unit",
        "gross_margin", "ebitda_margin", "asset_turnover", "roce",
        "inventory_days", "capex_to_sales", "fcf_yield",
    ],
    "it_services": [
        "revenue_growth_cc", "ebit_margin", "utilisation", "attrition",
        "large_deal_tcv", "headcount_growth", "dso", "fcf_conversion",
        "revenue_per_employee",
    ],
    "conglomerate": [
        "segment_ebitda_mix", "consolidated_roce", "net_debt", "fcf",
        "capex_allocation", "sop_discount", "revenue_growth_consumer",
    ],
}

# Industry words -> framework, first match wins.
FRAMEWORK_WORDS = [
    ("bank", "bank|nbfc|finance|lending|microfinance|housing finance"),
    ("epc", "epc|infrastructure|construction|project|power transmission|roads|irrigation"),
    ("manufacturing", "manufactur|steel|cement|chemical|pharma|auto|textile|paper|glass|plastic"),
    ("it_services", "information technology|it service|software|bpo|technology service"),
    ("conglomerate", "conglomerate|diversified|holding"),
]

# Report sections in display order.
REPORT_SECTIONS = [
    ("business_overview", "Business Overview"),
    ("industry_context", "Industry Context"),
    ("competitive_position", "Competitive Position"),
    ("segment_analysis", "Segment Analysis"),
    ("what_changed", "What Changed This Year"),
    ("historical_financials", "Historical Financial Analysis"),
    ("financial_ratios", "Financial Ratios"),
    ("cash_flow_analysis", "Cash Flow Analysis"),
    ("balance_sheet_analysis", "Balance Sheet Analysis"),
    ("receivables_analysis", "Receivables"),
    ("inventory_analysis", "Inventory"),
    ("payables_analysis", "Payables"),
    ("working_capital_analysis", "Working Capital"),
    ("debt_liquidity", "Debt & Liquidity"),
    ("management_analysis", "Management Commentary"),
    ("strategy_capital_allocation", "Strategy & Capital Allocation"),
    ("guidance_outlook", "Guidance & Outlook"),
    ("guidance_vs_execution", "Guidance vs Execution"),
    ("related_party_transactions", "Related-Party Transactions"),
    ("shareholding_ownership", "Shareholding & Ownership"),
    ("governance_analysis", "Governance"),
    ("subsidiaries_jvs", "Subsidiaries & JVs"),
    ("auditor_analysis", "Auditor Analysis"),
    ("accounting_analysis", "Accounting Analysis"),
    ("material_risks", "Material Risks"),
    ("catalysts_positives", "Catalysts & Positive Developments"),
    ("investor_monitoring_points", "Investor Monitoring Points"),
]

# Report sections that seed the executive summary.
SUMMARY_SEED_SECTIONS = [
    "business_overview", "historical_financials", "cash_flow_analysis",
    "material_risks", "catalysts_positives", "investor_monitoring_points",
]

# Summary items and the sections they fall back to, in order.
SUMMARY_FALLBACK = {
    "whatIsHappening": ["financial", "business"],
    "biggestPositive": ["positives", "business"],
    "biggestConcern": ["risks", "cash_balance_sheet"],
    "whatMattersMost": ["business", "financial"],
    "whatToWatch": ["risks", "management"],
    "investorTakeaway": ["business", "financial", "risks"],
}

# Sections that keep anchored claims only.
ANCHOR_ONLY_SECTIONS = [
    "governance", "shareholders", "subsidiaries", "positives",
]
