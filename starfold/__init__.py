"""Preference-data preparation and ranking evaluation as Spark DataFrame operators."""
