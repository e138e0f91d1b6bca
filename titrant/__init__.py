"""titrant: laboratory-report and health-reference analytics as Spark DataFrame operators."""
