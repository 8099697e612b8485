"""Labels from text and paths, and numbers from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremor.config import ALIASES, CLASSES


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def normalize_label(label: Column) -> Column:
    """The class that a label stands for; labels that are no alias pass in small letters, nulls stay."""
    key = F.lower(F.trim(label))
    return F.coalesce(F.try_element_at(_map(ALIASES), key), key)


def _stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))


def _parent(path: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(F.concat(F.lit("/"), path), "/", -2), "/", 1))


def _named(path: Column, names: dict[str, str]) -> list[Column]:
    """For each class, whether a name that stands for it is in a file's stem. Plain conditions, since functions over arrays would find the stem anew for each name."""
    stem = _stem(path)
    return [reduce(Column.__or__, [F.contains(stem, F.lit(name)) for name, of in names.items() if of == c]) for c in CLASSES]


def _first(named: list[Column]) -> Column:
    return F.coalesce(*[F.when(hit, c) for hit, c in zip(named, CLASSES)])


def _only(named: list[Column]) -> Column:
    return F.when(reduce(Column.__add__, [hit.cast("int") for hit in named]) == 1, _first(named))


def label_from_stem(path: Column) -> Column:
    """The class named in a file's stem, if exactly one is."""
    return _only(_named(path, dict(zip(CLASSES, CLASSES))))


def label_from_path(path: Column) -> Column:
    """The folder's name if it is a class, else the class of all aliases in the file's name, if they agree on one."""
    return F.when(_parent(path).isin(*CLASSES), _parent(path)).otherwise(_only(_named(path, ALIASES)))


def label_from_path_first(path: Column) -> Column:
    """The folder's name if it is a class, else the first class, in order, in the file's name."""
    return F.when(_parent(path).isin(*CLASSES), _parent(path)).otherwise(_first(_named(path, dict(zip(CLASSES, CLASSES)))))


#: Texts that a cast would read as numbers and that are none: with a trailing d or f, and NaN, after which a cast strips blanks and control characters.
NO_NUMBER = r"(?i)([0-9.][df]|nan[\x00-\x20]*)$"


def to_number(text: Column) -> Column:
    """A number from text; what is none, NaN included, becomes null. Infinities stay. A trailing d or f makes no number.

    NaN is told by its text, not by the number, so that the text is cast in one place of the expression and not in each that asks for the number.
    """
    plain = F.trim(text.cast("string"))
    return F.when(~plain.rlike(NO_NUMBER), plain.try_cast("double"))


def confidence_level(confidence: Column, inclusive: bool = False) -> Column:
    """high above 0.7, medium above 0.4, else low; inclusive: from 0.7 and 0.4 on."""
    over = (lambda v: confidence >= v) if inclusive else (lambda v: confidence > v)
    return F.when(over(0.7), "high").when(over(0.4), "medium").otherwise("low")


def scale_counts(counts: Column, per_g: float) -> Column:
    """Sensor counts to g."""
    return counts / per_g
