"""Column expressions: text, time, and the fixed values behind them."""
