"""Query of the HTML extraction."""

from __future__ import annotations

from . import html_text
from .common import read_table
from .queries import register


@register("op8_html_extraction")
def op8_html_extraction(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))
