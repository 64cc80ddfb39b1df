"""Input and output schemas as Spark DDL."""

COMPANIES = (
    "company_id STRING, name STRING, legal_name STRING, ticker STRING, "
    "exchange STRING, isin STRING, sector STRING, industry STRING, "
    "sub_industry STRING, company_type STRING, parent_company_id STRING, "
    "reporting_currency STRING, fiscal_year_end STRING, is_active BOOLEAN, "
    "short_description STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)

INCOMING_METRICS = (
    "arrival BIGINT, company_id STRING, metric_name STRING, "
    "metric_value DOUBLE, metric_unit STRING, currency STRING, "
    "reporting_period STRING, statement_type STRING, accounting_basis STRING, "
    "entity_name STRING, extracted_from STRING, extraction_notes STRING, "
    "source_name STRING, source_tier INT, source_url STRING, "
    "source_date DATE, source_document_id STRING"
)

DISCOVERED_ITEMS = (
    "arrival DECIMAL(38,0), company_id STRING, source_type STRING, title STRING, "
    "headline STRING, summary STRING, publication_date TIMESTAMP, "
    "publisher STRING, original_url STRING, document_url STRING, "
    "quarter STRING, financial_year STRING, content_hash STRING, "
    "metadata MAP<STRING,STRING>"
)

RAW_FEED = (
    "company_id STRING, fetched_at TIMESTAMP, source STRING, "
    "content_type STRING, http_status INT, error_name STRING, payload STRING"
)

DOCUMENT_PAGES = (
    "document_id STRING, company_id STRING, page_num INT, text STRING, "
    "char_count INT, is_empty BOOLEAN"
)

CITATION = (
    "STRUCT<chunk_index:INT,page_start:INT,page_end:INT,chunk_label:STRING>"
)

CALCULATION = (
    "STRUCT<metric:STRING,inputs:ARRAY<STRUCT<label:STRING,value:DOUBLE,"
    "unit:STRING,period:STRING,basis:STRING>>,formula:STRING,result:DOUBLE,"
    "result_label:STRING,period:STRING>"
)

FINDINGS = (
    "company_id STRING, document_id STRING, finding_pos BIGINT, "
    "finding_id STRING, specialist STRING, report_section STRING, "
    "research_question STRING, fact STRING, data_points ARRAY<STRING>, "
    f"calculations ARRAY<{CALCULATION}>, analysis STRING, "
    "investor_implication STRING, classification STRING, confidence STRING, "
    "accounting_basis STRING, period STRING, "
    f"citations ARRAY<{CITATION}>, supporting_quote STRING, "
    "insufficient_evidence BOOLEAN, insufficient_reason STRING"
)

CONCLUSIONS = (
    "company_id STRING, document_id STRING, section_key STRING, pos BIGINT, "
    "claim STRING, classification STRING, confidence STRING, "
    "accounting_basis STRING, financial_figure BOOLEAN, "
    "evidence_ids ARRAY<STRING>"
)

# Landed payloads of the exchanges.
ANNOUNCEMENTS = (
    "STRUCT<Table:ARRAY<STRUCT<NEWSID:STRING,SCRIP_CD:BIGINT,NEWSSUB:STRING,"
    "HEADLINE:STRING,DT_TM:STRING,NEWS_DT:STRING,CATEGORYNAME:STRING,"
    "SUBCATNAME:STRING,MORE:STRING,ATTACHMENTNAME:STRING>>>"
)

RESULTS = (
    "STRUCT<resCmpData:ARRAY<STRUCT<re_from_dt:STRING,re_to_dt:STRING,"
    "re_res_type:STRING,re_net_sale:STRING,re_net_profit:STRING,"
    "re_oth_inc_new:STRING,re_pro_loss_bef_tax:STRING,"
    "re_depr_und_exp:STRING,re_int_new:STRING,re_basic_eps:STRING,"
    "re_basic_eps_for_cont_dic_opr:STRING,re_desc_note_fin:STRING,"
    "re_desc_note_seg:STRING>>>"
)

LISTED_FILINGS = (
    "ARRAY<STRUCT<subject:STRING,category:STRING,period:STRING,`date`:STRING,"
    "`timestamp`:STRING,`desc`:STRING,recordId:STRING,id:STRING,"
    "attchmntFile:STRING>>"
)

RESULT_FILINGS = (
    "ARRAY<STRUCT<period:STRING,xbrl_date:STRING,`date`:STRING,`desc`:STRING,"
    "seqno:STRING,xbrl:STRING>>"
)

EXCHANGE_B_FILINGS = (
    "STRUCT<Table:ARRAY<STRUCT<CATEGORYNAME:STRING,Category:STRING,"
    "PERIOD:STRING,FILLINGDATE:STRING,`DATE`:STRING,HEADLINE:STRING,"
    "NEWSID:STRING,ATTACHMENTNAME:STRING>>>"
)
