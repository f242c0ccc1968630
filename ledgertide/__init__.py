"""Analytics for case-lifecycle records on Spark: cubes, panels, survival, audits, forecasts."""
