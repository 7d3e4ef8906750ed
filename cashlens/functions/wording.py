"""Feature labels, units, and value → phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# --- Fixed values: label and unit of every described feature ---------------------------------
FEATURE_TEXT = {
    "pay_dpd_mean_w6": ("Retraso medio de pago a proveedores (6 m)", "días"),
    "pay_dpd_mean_w3": ("Retraso medio de pago a proveedores (3 m)", "días"),
    "pay_dpd_mean_w12": ("Retraso medio de pago a proveedores (12 m)", "días"),
    "pay_dpd_p90_w6": ("Retraso p90 de pago a proveedores (6 m)", "días"),
    "pay_bad_share_w6": ("% facturas a pagar con más de 30 días de retraso (6 m)", "%"),
    "pay_bad_share_w12": ("% facturas a pagar con más de 30 días de retraso (12 m)", "%"),
    "pay_bad_share_w3": ("% facturas a pagar con más de 30 días de retraso (3 m)", "%"),
    "pay_open_overdue_share_w3": ("% facturas a pagar vencidas y abiertas (3 m)", "%"),
    "pay_open_overdue_share_w6": ("% facturas a pagar vencidas y abiertas (6 m)", "%"),
    "pay_open_overdue_share_w12": ("% facturas a pagar vencidas y abiertas (12 m)", "%"),
    "pay_amt_open_overdue_ratio_w6": ("Importe vencido abierto sobre facturado a pagar (6 m)", "%"),
    "pay_amt_open_overdue_ratio_w12": ("Importe vencido abierto sobre facturado a pagar (12 m)", "%"),
    "pay_open_overdue_trend6": ("Tendencia del % de facturas vencidas abiertas (6 m)", "pp/mes"),
    "pay_dpd_trend6": ("Tendencia del retraso de pago (6 m)", "días/mes"),
    "pay_max_open_dpd_w12": ("Factura a pagar más antigua sin pagar", "días"),
    "rec_open_overdue_share_w6": ("% facturas a cobrar vencidas y abiertas (6 m)", "%"),
    "rec_open_overdue_share_w3": ("% facturas a cobrar vencidas y abiertas (3 m)", "%"),
    "rec_dpd_mean_w6": ("Retraso medio de cobro de clientes (6 m)", "días"),
    "rec_bad_share_w6": ("% facturas a cobrar con más de 30 días de retraso (6 m)", "%"),
    "cash_balance_T_log": ("Saldo de caja reconstruido a fin de mes", "log€"),
    "cash_months_of_outflow": ("Meses de gasto operativo cubiertos por la caja", "meses"),
    "days_of_cash": ("Días de caja", "días"),
    "cash_min_w6_norm": ("Saldo mínimo de caja (6 m) sobre gasto mensual", "x"),
    "cash_neg_months_w3": ("Meses en descubierto (3 m)", "meses"),
    "cash_neg_months_w6": ("Meses en descubierto (6 m)", "meses"),
    "cash_neg_months_w12": ("Meses en descubierto (12 m)", "meses"),
    "cash_trend6": ("Tendencia del saldo de caja (6 m)", "x gasto/mes"),
    "cash_vol6": ("Volatilidad del saldo de caja (6 m)", "x"),
    "io_ratio_w3": ("Ratio cobros/pagos (3 m)", "x"),
    "io_ratio_w6": ("Ratio cobros/pagos (6 m)", "x"),
    "io_ratio_w12": ("Ratio cobros/pagos (12 m)", "x"),
    "io_ratio_w1": ("Ratio cobros/pagos (último mes)", "x"),
    "io_ratio_trend6": ("Tendencia del ratio cobros/pagos (6 m)", "x/mes"),
    "inflow_w3_vs_w12": ("Cobros últimos 3 m frente a media 12 m", "x"),
    "inflow_trend6": ("Tendencia de cobros (6 m)", "log/mes"),
    "net_flow_norm_w3": ("Flujo neto sobre pagos (3 m)", "x"),
    "interest_n_w6": ("Liquidaciones de intereses/descubierto (6 m)", "n"),
    "interest_n_w3": ("Liquidaciones de intereses/descubierto (3 m)", "n"),
    "interest_n_w12": ("Liquidaciones de intereses/descubierto (12 m)", "n"),
    "interest_trend6": ("Tendencia de liquidaciones de intereses (6 m)", "n/mes"),
    "credit_util_T": ("Utilización de líneas de crédito", "%"),
    "credit_util_max_w6": ("Utilización máxima de líneas de crédito (6 m)", "%"),
    "hhi_in": ("Concentración de cobros por cliente (HHI)", "idx"),
    "top1_in_share": ("Peso del mayor cliente en los cobros", "%"),
    "n_eff_clients": ("Número efectivo de clientes", "n"),
    "cp_in_churn": ("Clientes perdidos frente al semestre anterior", "%"),
    "hhi_out": ("Concentración de pagos por proveedor (HHI)", "idx"),
    "stress_terms_rate_w6": ("Movimientos con términos de estrés (devolución, impagado…) (6 m)", "%"),
    "stress_terms_rate_w3": ("Movimientos con términos de estrés (3 m)", "%"),
    "no_counterparty_share_w3": ("Movimientos sin contrapartida resuelta (3 m)", "%"),
    "reconciled_share_w3": ("Movimientos conciliados (3 m)", "%"),
    "reconciled_delta_w3_w12": ("Cambio en la tasa de conciliación (3 m vs 12 m)", "pp"),
    "salary_months_share_w6": ("Meses con pago de nóminas (6 m)", "%"),
    "salary_day_mean_w3": ("Día del mes en que se pagan las nóminas (3 m)", "día"),
    "tax_months_share_w6": ("Meses con pago de impuestos (6 m)", "%"),
    "tax_amt_ratio_w3_w12": ("Impuestos pagados 3 m frente a media 12 m", "x"),
    "ss_months_share_w6": ("Meses con pago de Seguridad Social (6 m)", "%"),
    "sib_pay_open_overdue_w6": ("% facturas vencidas abiertas de las empresas hermanas del grupo", "%"),
    "sib_cash_neg_months_w6": ("Meses en descubierto de las empresas hermanas (6 m)", "meses"),
    "bank_peer_pay_open_overdue_w6": ("% facturas vencidas de empresas del mismo banco principal", "%"),
    "n_tx_w3_vs_w12": ("Actividad transaccional 3 m frente a 12 m", "x"),
    "inactive_months_w6": ("Meses sin transacciones (6 m)", "meses"),
    "months_since_last_invoice": ("Meses desde la última factura sincronizada del ERP", "meses"),
    "inv_issued_ratio_w3_w12": ("Facturas emitidas 3 m frente a media 12 m", "x"),
    "debt_service_ratio_w6": ("Servicio de la deuda sobre cobros (6 m)", "%"),
    "debt_granted_total": ("Financiación concedida total", "log€"),
    "n_debt_products": ("Número de productos de financiación", "n"),
    "n_banks": ("Número de bancos", "n"),
    "tenure_months": ("Antigüedad en la plataforma", "meses"),
    "months_in_panel": ("Meses de historial disponible", "meses"),
    "group_size": ("Tamaño del grupo empresarial", "empresas"),
    "turnover_out_w12_log": ("Pagos operativos anuales", "log€"),
    "turnover_in_w12_log": ("Cobros operativos anuales", "log€"),
    "cash_conversion_days_w6": ("Ciclo de cobro aproximado (emisión → cobro)", "días"),
    "n_tx_w1": ("Transacciones en el último mes", "n"),
    "n_tx_w3_log": ("Transacciones en 3 meses", "log"),
    "active_days_w3": ("Días con actividad bancaria (3 m)", "días"),
    "inv_n_counterparties_w3": ("Contrapartidas distintas en facturas (3 m)", "n"),
    "n_counterparties_w3_mean": ("Contrapartidas bancarias distintas por mes (3 m)", "n"),
    "discarded_share_w3": ("Movimientos descartados en conciliación (3 m)", "%"),
    "no_accounting_share_w3": ("Movimientos sin estado contable (3 m)", "%"),
    "inflow_vol6": ("Volatilidad de cobros (6 m)", "x"),
    "bank_peer_cash_neg_months_w6": ("Meses en descubierto de empresas del mismo banco (6 m)", "meses"),
    "bank_peer_interest_n_w6": ("Liquidaciones de intereses de empresas del mismo banco (6 m)", "n"),
    "sib_stress_rate_w6": ("Términos de estrés en empresas hermanas del grupo (6 m)", "%"),
    "sib_io_ratio_w3": ("Ratio cobros/pagos de las empresas hermanas (3 m)", "x"),
    "sib_interest_n_w6": ("Liquidaciones de intereses de las empresas hermanas (6 m)", "n"),
    "n_siblings_active": ("Empresas hermanas activas en el grupo", "n"),
    "main_bank": ("Banco principal", "cat"), "erp_any": ("ERP", "cat"), "country": ("País", "cat"),
    "currency": ("Divisa", "cat"), "size_cohort": ("Cohorte de tamaño", "cat"),
    "has_invoices": ("Facturación sincronizada desde ERP", "bool"), "country_missing": ("País no informado", "bool"),
    "erp_missing": ("Sin ERP conectado", "bool"), "n_bank_accounts": ("Cuentas corrientes", "n"), "n_cards": ("Tarjetas", "n"),
    "n_credit_lines": ("Líneas de crédito", "n"), "n_loans": ("Préstamos", "n"), "wavg_interest_rate": ("Tipo de interés medio", "x"),
    "credit_util_trend6": ("Tendencia de utilización de líneas (6 m)", "x/mes"), "outflow_trend6": ("Tendencia de pagos (6 m)", "log/mes"),
    "n_tx_trend6": ("Tendencia de actividad transaccional (6 m)", "log/mes"), "fee_amt_ratio_w6": ("Comisiones sobre pagos (6 m)", "%"),
    "pending_status_share_w3": ("Movimientos pendientes de contabilizar (3 m)", "%"), "uncategorized_share_w3": ("Movimientos sin categoría (3 m)", "%"),
    "inv_issued_w3_log": ("Facturas emitidas (3 m)", "log"), "inv_no_cp_share_w6": ("Facturas sin contrapartida (6 m)", "%"),
    "inv_stress_rate_w6": ("Facturas con términos de estrés (6 m)", "%"), "cash_withdrawal_share_w6": ("Retiradas de efectivo sobre movimientos (6 m)", "%"),
    "refund_share_w6": ("Devoluciones sobre movimientos (6 m)", "%"), "salary_amt_ratio_w3_w12": ("Nóminas 3 m frente a media 12 m", "x"),
    "salary_day_delta": ("Cambio en el día de pago de nóminas (3 m vs 12 m)", "días"), "ss_amt_ratio_w3_w12": ("Seg. Social 3 m frente a media 12 m", "x"),
    "ss_day_mean_w3": ("Día del mes de pago de Seg. Social (3 m)", "día"), "tax_share_of_outflow_w6": ("Impuestos sobre pagos (6 m)", "%"),
    "pay_n_w6_log": ("Facturas a pagar vencidas en 6 m", "log"), "rec_n_w6_log": ("Facturas a cobrar vencidas en 6 m", "log"),
    "pay_term_days_w6": ("Plazo medio de pago pactado (6 m)", "días"), "pay_open_overdue_cv12": ("Estacionalidad del impago (12 m)", "x"),
    "rec_open_overdue_trend6": ("Tendencia del % de facturas a cobrar vencidas (6 m)", "pp/mes"), "rec_dpd_mean_w3": ("Retraso medio de cobro de clientes (3 m)", "días"),
    "rec_amt_open_overdue_ratio_w6": ("Importe a cobrar vencido sobre facturado (6 m)", "%"), "pay_bad_share_delta3": ("Cambio en % facturas con >30 d (3 m)", "pp"),
    "hhi_in_delta3": ("Cambio en concentración de clientes (3 m)", "idx"), "top1_in_delta3": ("Cambio en peso del mayor cliente (3 m)", "pp"),
    "top1_out_share": ("Peso del mayor proveedor en los pagos", "%"), "n_cp_in_log": ("Clientes con cobros identificados (6 m)", "log"),
    "n_cp_out_log": ("Proveedores con pagos identificados (6 m)", "log"), "resolved_inflow_share_w6": ("Cobros con contrapartida identificada (6 m)", "%"),
    "no_counterparty_delta_w3_w12": ("Cambio en movimientos sin contrapartida (3 m vs 12 m)", "pp"), "no_accounting_delta_w3_w12": ("Cambio en movimientos sin estado contable", "pp"),
    "stress_terms_n_w3": ("Movimientos con términos de estrés (3 m)", "n"), "stress_trend6": ("Tendencia de términos de estrés (6 m)", "pp/mes"),
    "stress_terms_rate_w12": ("Movimientos con términos de estrés (12 m)", "%"), "interest_amt_ratio_w6": ("Intereses/comisiones de descubierto sobre pagos (6 m)", "%"),
    "n_cash_accounts_neg_T": ("Cuentas en negativo a fin de mes", "n"), "credit_drawn_T_log": ("Crédito dispuesto", "log€"), "card_drawn_T_log": ("Saldo de tarjetas", "log€"),
    "debt_repayment_trend6": ("Tendencia de amortización de deuda (6 m)", "log/mes"), "inflow_w1_log": ("Cobros del último mes", "log€"), "outflow_w1_log": ("Pagos del último mes", "log€"),
    "inflow_w3_log": ("Cobros (3 m)", "log€"), "outflow_w3_log": ("Pagos (3 m)", "log€"), "inflow_w6_log": ("Cobros (6 m)", "log€"), "outflow_w6_log": ("Pagos (6 m)", "log€"),
    "n_products_total": ("Productos bancarios conectados", "n"), "main_bank_share": ("Peso del banco principal", "%"), "loan_granted_total": ("Préstamos concedidos", "log€"),
    "total_periods_mean": ("Plazo medio de los préstamos", "n"), "share_variable_rate": ("Deuda a tipo variable", "%"), "n_leasing": ("Leasings", "n"),
    "n_guarantees": ("Avales", "n"), "n_confirming_factoring": ("Confirming / factoring", "n"),
}

# --- Fixed values: profile features nobody can act on, and the metric that moves a feature ----
PROFILE = ("country", "currency", "erp_any", "main_bank", "size_cohort", "tenure_months", "months_in_panel",
           "group_size", "country_missing", "erp_missing", "has_invoices")
FEATURE_METRIC = {
    "cash_conversion_days_w6": "dso", "rec_dpd_mean_w3": "dso", "rec_dpd_mean_w6": "dso",
    "pay_dpd_mean_w3": "dpo", "pay_dpd_mean_w6": "dpo", "pay_term_days_w6": "dpo",
    "debt_service_ratio_w6": "dscr",
    "days_of_cash": "cash_days", "cash_months_of_outflow": "cash_days", "cash_min_w6_norm": "cash_days",
    "credit_util_T": "credit_usage", "credit_util_max_w6": "credit_usage",
    "top1_in_share": "concentration",
}


def dictionary(spark: SparkSession) -> DataFrame:
    """Feature dictionary as a table (feature, label, unit, metric_id)."""
    rows = [(f, lab, unit, FEATURE_METRIC.get(f)) for f, (lab, unit) in FEATURE_TEXT.items()]
    return spark.createDataFrame(rows, "feature string, label string, unit string, metric_id string")


def fixed(v: Column, digits: int, flags: str = "") -> Column:
    """Fixed-point text, halves to even; a negative value that rounds to zero keeps its sign."""
    r = F.bround(v, digits)
    text = F.format_string(f"%{flags}.{digits}f", r)
    return F.when((v < 0) & (r == 0) & ~F.lit("+" in flags), F.concat(F.lit("-"), text)).otherwise(text)


def phrase(label: Column, unit: Column, value: Column) -> Column:
    """Plain sentence for a value by unit; missing and near-zero values handled."""
    v = F.when(F.abs(value) < 5e-3, 0.0).otherwise(value)
    counted = unit.isin("días", "meses", "n", "empresas", "día")
    text = (F.when(value.isNull(), "sin dato")
            .when(unit == "pp", F.concat(fixed(100 * v, 0, "+"), F.lit(" pp")))
            .when(unit == "bool", F.when(v >= 0.5, "sí").otherwise("no"))
            .when(unit == "log", fixed(F.expm1(v), 0, ","))
            .when(unit == "%", F.concat(fixed(100 * v, 0), F.lit("%")))
            .when(unit == "log€", F.concat(fixed(F.signum(v) * F.expm1(F.abs(v)), 0, ","), F.lit(" €")))
            .when(counted, F.concat(fixed(v, 0), F.lit(" "), unit))
            .otherwise(F.rtrim(F.concat(fixed(v, 2), F.lit(" "), unit))))
    return F.concat(label, F.lit(": "), text)


def with_text(df: DataFrame, value: str = "value", out: str = "text") -> DataFrame:
    """Add the phrase of (feature, value); the dictionary has one row per feature, about 150."""
    d = dictionary(df.sparkSession).select("feature", "label", "unit")
    j = df.join(F.broadcast(d), "feature", "left")
    label, unit = F.coalesce("label", "feature"), F.coalesce("unit", F.lit(""))
    return j.withColumn(out, phrase(label, unit, F.col(value))).drop("label", "unit")
