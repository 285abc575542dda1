"""Scalar expressions and helpers shared by the operators."""
