"""Number, date, status and rule functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# fixed values: seconds before each further try
_WAITS = (30, 120, 600)


def backoff_seconds(attempt: Column | str) -> Column:
    attempt = _col(attempt)
    return F.when(attempt <= 1, _WAITS[0]).when(attempt == 2, _WAITS[1]).otherwise(_WAITS[2])


def with_fifth(tokens: Column) -> Column:
    """A size and a fifth of it, in whole numbers: the hard limit of a chunk."""
    return (tokens + F.floor(tokens / 5)).cast("int")


def cost_micro(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Micro-dollars for tokens at prices per million; each part is cut to whole numbers."""
    part = lambda n, p: F.floor(n * p / F.lit(1_000_000).cast("decimal(10,0)")).cast("long")
    return part(tokens_in.cast("decimal(19,0)"), price_in.cast("decimal(12,0)")) + part(tokens_out.cast("decimal(19,0)"), price_out.cast("decimal(12,0)"))


def period(ts: Column | str) -> Column:
    return F.trunc(_col(ts), "month")


def next_period(ts: Column | str) -> Column:
    return F.add_months(period(ts), 1)


def year_ce(text: Column | str) -> Column:
    """The first plausible year of a date: Buddhist years 2400-2700 less 543, common years 1990-2100 as they are."""
    years = F.transform(F.regexp_extract_all(_col(text), F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int"))
    common = F.transform(years, lambda y: F.when(y.between(2400, 2700), y - 543).when(y.between(1990, 2100), y))
    return F.try_element_at(F.array_compact(common), F.lit(1))


def effective_status(status: Column | str, expires: Column | str, now: Column) -> Column:
    status = _col(status)
    return F.when((status == "active") & (_col(expires) <= now), "expired").otherwise(status)


def out_of_range(ranges: dict[str, tuple[Column, float, float]]) -> Column:
    """Names of the settings that are null or out of their range, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(value.between(low, high), F.lit(False)), name) for name, (value, low, high) in ranges.items()]))


def config_problems(c: dict[str, Column]) -> Column:
    """Names of the settings of an agent that break a rule, in a fixed order; a null setting breaks its rule.

    ``c``: schema_version, instructions, top_k, budget, relevance, lambda, strict,
    fallback, history and tools (an array).
    """
    holds = {
        "schema_version": c["schema_version"] == 1, "instructions": F.char_length(c["instructions"]) <= 20_000, "top_k": c["top_k"].between(1, 50), "budget": c["budget"].between(500, 100_000),
        "relevance": c["relevance"].between(0, 1), "lambda": c["lambda"].between(0, 1), "fallback": ~c["strict"] | (F.trim(c["fallback"]) != ""), "history": c["history"].between(0, 50), "tools": F.size(c["tools"]) == 0,
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in holds.items()]))


def valid_name(name: Column | str, most: int = 200) -> Column:
    return F.char_length(F.trim(_col(name))).between(1, most)


def valid_slug(slug: Column | str) -> Column:
    return _col(slug).rlike(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$")


def normal_email(email: Column | str) -> Column:
    return F.lower(F.trim(_col(email)))


def stable_id(*parts: Column) -> Column:
    """An id that a rerun makes again: 26 digits of a digest of its parts."""
    return F.left(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256), F.lit(26))


def cover_density(text: Column | str, terms: list[str]) -> Column:
    """Rank of a text for terms it must have all of: a tenth for each smallest stretch
    with all terms, divided by one more than the words in it beyond the terms.

    A stretch ends at a word where each term's latest place is known; it is smallest
    if it begins later than the one before.  One pass folds over the words.
    """
    words = F.filter(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*terms))
    start = F.struct(F.lit(0.0).cast("double").alias("rank"), F.lit(-1).alias("low"), *[F.lit(-1).alias(f"t{k}") for k in range(len(terms))])

    def step(acc: Column, x: Column) -> Column:
        at = [F.when(x["w"] == term, x["i"]).otherwise(acc[f"t{k}"]) for k, term in enumerate(terms)]
        low = F.least(*at) if len(at) > 1 else at[0]
        gain = F.when((low >= 0) & (low > acc["low"]), 0.1 / (1.0 + (x["i"] - low + 1 - len(terms)))).otherwise(0.0)
        return F.struct((acc["rank"] + gain).cast("double").alias("rank"), F.greatest(low, acc["low"]).alias("low"), *[a.alias(f"t{k}") for k, a in enumerate(at)])

    return F.aggregate(placed, start, step, lambda acc: acc["rank"])


# fixed values: common words that tell the languages of the corpus apart
COMMON = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "was", "for", "with"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "mit", "von", "auf", "den"),
    "es": ("el", "los", "las", "que", "una", "por", "con", "para", "del", "se"),
    "fr": ("le", "les", "des", "est", "et", "une", "dans", "pour", "que", "du"),
}


def language(text: Column | str, least_chars: int = 20) -> Column:
    """The language whose common words a text has most of; null if short or undecided."""
    c = _col(text)
    words = F.split(F.lower(c), r"[^\p{L}]+")
    among = lambda common: F.size(F.filter(words, lambda w: w.isin(*common)))
    counts = [F.struct(among(common).alias("n"), F.lit(name).alias("name")) for name, common in COMMON.items()]
    ranked = F.reverse(F.array_sort(F.array(*counts)))
    return F.when((F.char_length(c) >= least_chars) & (ranked[0]["n"] > ranked[1]["n"]), ranked[0]["name"])
