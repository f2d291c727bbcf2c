"""Feature building and forecasting for panels of hourly series, on Spark."""
