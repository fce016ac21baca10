"""Masked-pair, question/answer, mixture and reward jobs as Spark DataFrame programs."""

__version__ = "0.1.0"
