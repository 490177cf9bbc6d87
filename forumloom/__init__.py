"""Forumloom: DataFrame operators that collect, clean, normalise, vectorise and classify short forum texts."""

__version__ = "0.1.0"
