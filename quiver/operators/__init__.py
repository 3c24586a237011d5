"""Operators over tables, positioned vectors, nested cells and matrices."""
