"""remitlens: bank-transfer anomaly analytics written with the Spark DataFrame API."""
