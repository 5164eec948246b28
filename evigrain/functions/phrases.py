"""Counts in phrases such as "8 to 10 slides", in English and Russian."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words and their values.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "один": 1, "одна": 1, "одно": 1, "одного": 1, "одной": 1, "одну": 1, "два": 2, "две": 2, "двух": 2, "три": 3, "трех": 3, "трёх": 3,
    "четыре": 4, "четырех": 4, "четырёх": 4, "пять": 5, "пяти": 5, "шесть": 6, "шести": 6, "семь": 7, "семи": 7, "восемь": 8, "восьми": 8,
    "девять": 9, "девяти": 9, "десять": 10, "десяти": 10, "одиннадцать": 11, "одиннадцати": 11, "двенадцать": 12, "двенадцати": 12,
    "тринадцать": 13, "тринадцати": 13, "четырнадцать": 14, "четырнадцати": 14, "пятнадцать": 15, "пятнадцати": 15, "шестнадцать": 16, "шестнадцати": 16,
    "семнадцать": 17, "семнадцати": 17, "восемнадцать": 18, "восемнадцати": 18, "девятнадцать": 19, "девятнадцати": 19, "двадцать": 20,
}
FEWEST, MOST = 5, 15

_TOKEN = rf"(?:\d+|{'|'.join(sorted(NUMBER_WORDS, key=len, reverse=True))})"
_CHAIN = rf"{_TOKEN}(?:\s*(?:[-–—]|до|to|или|либо|or|and|и)\s*{_TOKEN})*"
_SLIDES = r"(?:слайд(?:а|ов|ы|е|ам|ами|ах)?|slides?)"
_VERBS = r"(?:должно\s+быть|должен\s+быть|должны\s+быть|будет|будут|составит|составят|равно|всего|ровно|should\s+be|will\s+be)"
BEFORE = rf"(?iuU)(?:^|[^\p{{L}}\p{{N}}])({_CHAIN})[\s,;:–—-]+{_SLIDES}(?=$|[^\p{{L}}\p{{N}}])"
AFTER = rf"(?iuU)(?:^|[^\p{{L}}\p{{N}}]){_SLIDES}(?:\s*(?:[:=—–]\s*|\s+{_VERBS}\s+|\s+))({_CHAIN})(?=$|[^\p{{L}}\p{{N}}])"


def counts(phrase: Column) -> Column:
    """Distinct numbers that stand before or after the word for slides."""
    chains = F.concat(F.regexp_extract_all(phrase, F.lit(BEFORE), F.lit(1)), F.regexp_extract_all(phrase, F.lit(AFTER), F.lit(1)))
    found = F.flatten(F.transform(chains, lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"(?iu){_TOKEN}"), F.lit(0))))
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.array_compact(F.array_distinct(F.transform(found, lambda t: F.coalesce(t.try_cast("long"), F.try_element_at(words, t).cast("long")))))


def effective_count(phrase: Column, selected: Column) -> Column:
    """slide_count and count_source: the one count that a phrase names if it is 5 to 15, else the selected one."""
    found = counts(phrase)
    named = (F.size(found) == 1) & F.get(found, 0).between(FEWEST, MOST)
    return F.struct(F.when(named, F.get(found, 0)).otherwise(selected.cast("long")).alias("slide_count"), F.when(named, "brief").otherwise("selection").alias("count_source"))
