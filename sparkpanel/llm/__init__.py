"""Operators for training and evaluation data of language models. Nothing outside this subpackage imports it."""
