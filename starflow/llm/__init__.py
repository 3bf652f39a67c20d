"""Operators that prepare large text corpora and vector tables for training."""
