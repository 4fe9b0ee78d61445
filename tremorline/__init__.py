"""Tremorline: batch analytics of seismic sequences on Spark."""
