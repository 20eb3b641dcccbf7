"""Peer-rating analytics on Spark."""
