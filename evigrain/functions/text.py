"""Text expressions: normalisation, splitting, extraction, inference. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_LIMIT = 50_000
SPACES = r"(?U)\s+"

# Words that are never keywords, and the sentences that fill up a short list of parts.
STOP_WORDS = ("это", "как", "для", "или", "что", "при", "без", "the", "and", "with", "from", "this", "презентация", "presentation", "тема", "нужно", "можно", "будет", "которые")
SUPPLEMENTS = ("Ценность для пользователя и ожидаемый эффект.", "Условия внедрения и важные ограничения.", "Метрика, по которой проверим результат.", "Следующий проверяемый шаг для команды.")
UNTITLED = "Новая презентация"
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"
PLACEHOLDER = r"(?iu)(?<![\p{L}\p{N}_])(?:lorem\s+ipsum|xxx|todo|вставьте\s+текст)(?![\p{L}\p{N}_])"
NEXT_STEPS = r"(?iu)(?:следующ(?:ий|ие|их)\s+шаг[а-яё]*|план\s+(?:дальнейших\s+)?действ[а-яё]*|рекомендац[а-яё]*)\s*[:—-]\s*([^\r\n]+)"


def trimmed(x: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapsed(x: Column) -> Column:
    return trimmed(F.regexp_replace(x, SPACES, " "))


def normalized(x: Column) -> Column:
    """The form in which texts are matched: collapsed and lower-case."""
    return F.lower(collapsed(x))


def shortened(x: Column, limit: int, keep: int) -> Column:
    """x, or its first `keep` characters without trailing space and an ellipsis if it is longer than limit."""
    return F.when(F.char_length(x) > limit, F.concat(F.regexp_replace(F.substring(x, 1, keep), r"(?U)\s+$", ""), F.lit("…"))).otherwise(x)


def compact(x: Column, limit: int) -> Column:
    return shortened(collapsed(x), limit, limit - 1)


def limited(x: Column) -> Column:
    return F.substring(x, 1, TEXT_LIMIT)


def line_count(x: Column) -> Column:
    return F.size(F.split(x, "\r\n|\n|\r"))


def line_locator(x: Column) -> Column:
    return F.concat(F.lit("lines:1-"), line_count(limited(x)).cast("string"))


def excerpts(x: Column) -> Column:
    """The first twelve sentences of 45 characters or more, each compacted to 280."""
    sentences = F.transform(F.split(F.regexp_replace(x, SPACES, " "), r"(?<=[.!?])\s+"), trimmed)
    return F.transform(F.slice(F.filter(sentences, lambda s: F.char_length(s) >= 45), 1, 12), lambda s: compact(s, 280))


def keyword_tokens(x: Column) -> Column:
    """Lower-cased runs of four or more letters, digits and hyphens that are no stop words."""
    found = F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}-]{4,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits (text is expected in NFKC)."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def inferred(x: Column) -> Column:
    """A typed cell: value_type with value_bool, value_num or value_str. Dates are not inferred."""
    bare = trimmed(x)
    flag, number = F.lower(bare).isin("true", "false"), bare.rlike(NUMBER)
    kind = F.when(flag, "boolean").when(number, "number").otherwise("string")
    return F.struct(kind.alias("value_type"), F.when(flag, F.lower(bare) == "true").alias("value_bool"), F.when(number & ~flag, bare.try_cast("double")).alias("value_num"), F.when(~flag & ~number, x).alias("value_str"))


def numeric_claims(x: Column) -> Column:
    found = F.regexp_extract_all(x, F.lit(r"(?<![\p{L}\d])[+-]?\d+(?:[.,]\d+)?"), F.lit(0))
    return F.transform(found, lambda v: F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))


def date_claims(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\b\d{4}-\d{2}-\d{2}\b"), F.lit(0))


def next_steps(x: Column) -> Column:
    """What follows a cue of next steps on its line, if it has 280 characters at most."""
    found = trimmed(F.regexp_extract(x, NEXT_STEPS, 1))
    return F.when((found != "") & (F.char_length(found) <= 280), found)


def brief_title(x: Column) -> Column:
    lines = F.filter(F.transform(F.split(x, "\n"), trimmed), lambda s: s != "")
    return shortened(F.coalesce(F.get(lines, 0), F.lit(UNTITLED)), 90, 87)


def split_signal(x: Column, count: int) -> Column:
    """The first `count` sentences or clauses of x, filled up with supplements, each cut to 140."""
    parts = F.slice(F.filter(F.transform(F.split(F.regexp_replace(x, "[;:]", "."), r"[.!?]\s+"), trimmed), lambda s: s != ""), 1, count)
    fill = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.get(F.array(*[F.lit(s) for s in SUPPLEMENTS]), F.pmod(i - 1, F.lit(len(SUPPLEMENTS)))))
    filled = F.when(F.size(parts) < count, F.concat(parts, F.slice(fill, F.size(parts) + 1, F.lit(count) - F.size(parts)))).otherwise(parts)
    return F.transform(filled, lambda s: shortened(s, 140, 137))


def round_robin(signals: Column, index: Column, fallback: Column) -> Column:
    found = F.get(signals, F.pmod(index, F.greatest(F.size(signals), F.lit(1))))
    return F.when(found.isNull() | (found == ""), fallback).otherwise(found)


def clauses(x: Column) -> Column:
    """Non-blank clauses between , ; . ! and ?"""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"[^,;.!?]+[,;.!?]?"), F.lit(0)), trimmed), lambda s: s != "")


def packed(items: Column, slots: int) -> Column:
    """Items dealt to slots one by one; what does not fit is joined into the last."""
    tail = F.array_join(F.slice(items, slots, F.greatest(F.size(items) - slots + 1, F.lit(0))), " · ")
    return F.when(F.size(items) <= slots, items).otherwise(F.concat(F.slice(items, 1, slots - 1), F.array(tail)))


def token_estimate(x: Column) -> Column:
    """Tokens at three UTF-8 bytes each, rounded up."""
    return F.ceil(F.octet_length(x) / 3).cast("long")


def is_placeholder(x: Column) -> Column:
    return x.rlike(PLACEHOLDER)


def redacted(x: Column, secrets: list[str], fallback: str = "Generation failed") -> Column:
    """One line of 240 characters at most with known secret values masked."""
    for secret in secrets:
        x = F.replace(x, F.lit(secret), F.lit("[redacted]"))
    line = F.substring(trimmed(F.regexp_replace(F.regexp_replace(x, r"[\r\n\t]+", " "), r"(?U)\s{2,}", " ")), 1, 240)
    return F.when(line == "", fallback).otherwise(line)


def safe_path(x: Column) -> Column:
    """Whether a path is relative and has no empty, '.' or '..' segment."""
    return x.isNotNull() & (x != "") & ~x.contains("\\") & ~F.exists(F.split(x, "/"), lambda s: s.isin("", ".", ".."))


_ENTITY = "&(#[xX][0-9A-Fa-f]+|#[0-9]+|[aA][mM][pP]|[lL][tT]|[gG][tT]|[qQ][uU][oO][tT]|[aA][pP][oO][sS]);"
NAMED_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded(x: Column) -> Column:
    """x with XML's five named entities and numeric ones decoded, each once; null where another entity or a number that is no character occurs."""
    names = F.create_map(*[F.lit(v) for pair in NAMED_ENTITIES.items() for v in pair])

    def character(entity: Column) -> Column:
        digits = F.regexp_replace(entity, "^#[xX]?0*", "")
        number = F.when(F.char_length(digits) > 8, F.lit(-1)).when(entity.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(digits.try_cast("long"))
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        point = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.when(F.startswith(entity, F.lit("#")), point).otherwise(F.try_element_at(names, F.lower(entity)))

    parts = F.split(x, _ENTITY)
    found = F.transform(F.regexp_extract_all(x, F.lit(_ENTITY), F.lit(1)), character)
    whole = F.array_join(F.zip_with(parts, found, lambda p, e: F.concat_ws("", p, e)), "")
    # A blank stands where an entity was: a lone ampersand before it must not meet the words behind it.
    foreign = F.regexp_replace(x, _ENTITY, " ").rlike(r"&[^\s;]+;")
    return F.when(~foreign & ~F.exists(found, lambda e: e.isNull()), whole)


FONT_FALLBACK = "Arial"


def resolved_font(observed: Column, configured: Column) -> Column:
    """The font that a slot shows, else the first non-blank one of its role's list, else the fallback."""
    known = F.filter(F.transform(F.coalesce(configured, F.array().cast("array<string>")), trimmed), lambda f: f != "")
    return F.coalesce(F.nullif(trimmed(observed), F.lit("")), F.get(known, 0), F.lit(FONT_FALLBACK))
