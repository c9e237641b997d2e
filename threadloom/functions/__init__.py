"""Column expressions: text, time, urls, ids. All run in the JVM."""

from .ids import blank_to_null, first_truthy, stable_id
from .text import STOP_WORDS, TOKEN, clean_text, message_kind, summary, tokens, top_keywords
from .time import iso_time
from .urls import extract_urls, split_url

__all__ = ["STOP_WORDS", "TOKEN", "blank_to_null", "clean_text", "extract_urls", "first_truthy", "iso_time", "message_kind", "split_url", "stable_id", "summary", "tokens", "top_keywords"]
