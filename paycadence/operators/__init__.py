"""Analytics operators over the canonical frames."""
