"""The functions that need Python, under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..workers import prepare
from .address import public_url_error
from .markdown_clean import clean_markdown
from .urls import normalise_reference, normalise_references

NAMES = {
    "clean_markdown": clean_markdown,
    "normalise_reference": normalise_reference,
    "normalise_references": normalise_references,
    "public_url_error": public_url_error,
}


def register(spark: SparkSession) -> None:
    prepare(spark)
    for name, function in NAMES.items():
        spark.udf.register(name, function)
