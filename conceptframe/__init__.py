"""Concept measurement over large collections of material, written as Spark DataFrame jobs."""
