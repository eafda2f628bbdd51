"""The reports. Each returns a DataFrame with money as DECIMAL dollars."""
