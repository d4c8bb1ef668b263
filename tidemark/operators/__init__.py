"""Analytics operators over ledgers and price series."""
