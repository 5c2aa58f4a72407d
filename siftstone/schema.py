"""Limits, field flags and document fields of the search model."""

from __future__ import annotations

from dataclasses import dataclass

# Limits that a query is checked against.
MAX_TERMS = 32
MAX_IN_VALUES = 512
MAX_IN_FIELDS = 8
MAX_GROUPS = 1024
MAX_TOP = 2000
MAX_FETCH = 1024
MAX_CATEGORIES = 64
MAX_SYNONYMS = 64
# Scoring constants.
TF_GAIN, TF_SHIFT, LENGTH_WEIGHT = 3.0, 0.5, 1.5
PHRASE_PAIR, PHRASE_FIELD_PAIR = 2, 4
FIXED_POINT = 100_000_000
SUMMARY_SCALE, SUMMARY_ADJACENT, SUMMARY_CHARS = 1_000_000, 10, 128


@dataclass(frozen=True)
class Field:
    """A field of a collection: its number in query strings, its column, and its kind."""

    number: int
    name: str
    kind: str  # text, int, long, double


@dataclass(frozen=True)
class Collection:
    """Fields by number, so that positional query strings can be read against named columns."""

    fields: tuple[Field, ...]

    def name(self, number: int) -> str:
        for f in self.fields:
            if f.number == number:
                return f.name
        raise KeyError(f"no field {number}")

    def text_bit(self, number: int) -> int:
        return 1 << number

    @property
    def text_fields(self) -> list[Field]:
        return [f for f in self.fields if f.kind == "text"]


DOCUMENTS = Collection(
    (
        Field(0, "text", "text"),
        Field(1, "source", "text"),
        Field(2, "n_chars", "int"),
        Field(3, "category", "long"),
        Field(4, "rank", "double"),
    )
)
