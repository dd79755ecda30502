"""Text for extraction by language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PROMPT = "Extract the requested fields from this page:\n\n{html}"


def strip_scripts_and_styles(html: Column) -> Column:
    """Without script and then style elements; one that is never closed takes the rest along."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{tag}.*?(</{tag}>|\z)", "")
    return html


def user_prompt(html: Column, template: str = DEFAULT_PROMPT) -> Column:
    """The template with ``{html}`` filled in."""
    return F.replace(F.lit(template), F.lit("{html}"), html)
