"""Sensor-count analytics on Spark: raw readings to star schema to forecast."""
