"""Venue ticket-sales analytics as DataFrame operators on Spark."""
