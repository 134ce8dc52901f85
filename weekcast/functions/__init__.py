from weekcast.functions.columns import col_, holiday_flag, parse_date, period_suffix, smape_term, to_number

__all__ = ["col_", "holiday_flag", "parse_date", "period_suffix", "smape_term", "to_number"]
