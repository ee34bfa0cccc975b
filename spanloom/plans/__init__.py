"""Whole translations as plans over tables."""
