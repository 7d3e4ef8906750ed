"""Treasury analytics on Spark: company-month panels, risk, health, projection and decisions."""
