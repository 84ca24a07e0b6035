"""Models behind the agents: forecasts, attributions, outliers and late payments, fitted and applied by Spark."""
