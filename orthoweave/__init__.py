"""Orthographic transparency on Spark: how closely a word's spelling resembles the words of its sense in other languages."""
