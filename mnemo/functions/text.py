"""Column expressions over texts: tokens, hashes, titles, language checks, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: function words of English prose
STOP_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with", "was", "on", "be", "by", "this", "are", "from", "or", "an", "at", "which", "not", "have", "has", "its", "we", "our", "were", "their", "will")
MIN_TOKENS, MIN_ASCII, MIN_STOPS = 30, 0.95, 0.12
MAX_PROMPT = 1500


def words(text: Column, pattern: str = "[a-z]+") -> Column:
    """Lower-case words by a pattern."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def prompt_key(prompt: Column) -> Column:
    """First 16 characters of the prompt's SHA-256."""
    return F.substring(F.sha2(prompt, 256), 1, 16)


def title_hash(title: Column) -> Column:
    return F.sha2(F.lower(F.trim(title)), 256)


def dedup_key(title: Column, prompt: Column) -> Column:
    """Hash of the trimmed lower-case title, else of the prompt."""
    return F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) > 0, title_hash(title)).otherwise(F.sha2(prompt, 256))


def english_looking(text: Column) -> Column:
    """At least 30 Latin words, nearly all ASCII, and a fair share of function words."""
    tokens = words(text)
    dense = F.regexp_replace(text, r"\s+", "")
    ascii_share = F.length(F.regexp_replace(dense, r"[^\x00-\x7F]+", "")) / F.greatest(F.length(dense), F.lit(1))
    stops = F.size(F.filter(tokens, lambda w: w.isin(*STOP_WORDS))) / F.greatest(F.size(tokens), F.lit(1))
    return (F.size(tokens) >= MIN_TOKENS) & (ascii_share >= MIN_ASCII) & (stops >= MIN_STOPS)


def title_like(line: Column) -> Column:
    """Twenty characters, three words, and mostly letters."""
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    solid = F.length(F.replace(line, F.lit(" "), F.lit("")))
    return (F.length(line) >= 20) & (letters >= 0.6 * solid) & (F.size(F.split(F.trim(line), r"\s+")) >= 3)


def first_title(lines: Column) -> Column:
    return F.get(F.filter(lines, title_like), F.lit(0))


def build_prompt(title: Column, body: Column, limit: int = MAX_PROMPT) -> Column:
    """Title, empty line, body; cut to a length and trimmed."""
    return F.trim(F.substring(F.concat_ws("\n\n", title, body), 1, limit))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is not null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def published_date(raw: Column) -> Column:
    """A date from an ISO date or datetime; null for anything else."""
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[T ])"), F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"))
