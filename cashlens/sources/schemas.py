"""Declared input schemas: typed columns only, anything else is trimmed text."""

# --- Fixed values: column types of the eight input tables ----------------------------------
TYPED = {
    "groups": {"n_companies_in_sample": "int"},
    "companies": {"created_at": "timestamp"},
    "banking_products": {"created_at": "timestamp"},
    "debt_products": {"created_at": "timestamp", "granted": "double", "outstanding": "double", "liquidity": "double"},
    "debt_schedule_config": {
        "granted_balance": "double", "outstanding_balance": "double", "total_periods": "int",
        "next_payment_date": "timestamp", "last_payment_date": "timestamp",
        "annual_interest_rate_or_spread": "double"},
    "balances": {"date": "timestamp", "balance": "double", "available": "double", "granted": "double",
                 "liquidity": "double", "countable": "double"},
    "transactions": {"date": "timestamp", "value_date": "timestamp", "amount": "double", "exchange_rate": "double"},
    "invoices": {"issuance_date": "timestamp", "due_date": "timestamp", "payment_date": "timestamp",
                 "amount": "double", "pending_amount": "double", "exchange_rate": "double"},
}
COLUMNS = {
    "groups": "group_id erp n_companies_in_sample",
    "companies": "company_id group_id country currency erp created_at",
    "banking_products": "product_id company_id label type bank_name service currency created_at",
    "debt_products": "product_id company_id label type bank_name service currency created_at granted outstanding liquidity",
    "debt_schedule_config":
        "product_id company_id settlement_product_id currency amortization_type interest_calc_method "
        "amortising_frequency granted_balance outstanding_balance total_periods next_payment_date "
        "last_payment_date annual_interest_rate_or_spread interest_type",
    "balances": "product_id company_id date balance available granted liquidity countable",
    "transactions":
        "transaction_id company_id product_id date value_date amount exchange_rate status accounting_status "
        "category description counterparty_id",
    "invoices":
        "operation_id company_id document_type issuance_date due_date payment_date amount pending_amount "
        "currency accounting_currency exchange_rate status concept counterparty_id",
}
TABLES = tuple(TYPED)
REQUIRED = ("companies", "banking_products", "transactions", "balances")
FACT_DATES = {"transactions": "date", "invoices": "issuance_date"}


def type_of(table: str, column: str) -> str:
    return TYPED[table].get(column, "string")


def ddl(table: str) -> str:
    return ", ".join(f"`{c}` {type_of(table, c)}" for c in COLUMNS[table].split())
