"""duskline: incident, outage and event analytics as Spark DataFrame operators."""
