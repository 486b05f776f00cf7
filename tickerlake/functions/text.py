"""Text columns: identifiers, keys, JSON payloads, keyword scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
EXCHANGE_SUFFIXES = {
    "NS": "NSE",
    "NSE": "NSE",
    "BO": "BSE",
    "BSE": "BSE",
    "SME": "BSE_SME",
    "BSE_SME": "BSE_SME",
}
NSE_SERIES = {"EQ": "EQ", "BE": "BE", "BZ": "BZ", "SM": "SM", "ST": "ST"}
BSE_SERIES = {"A": "EQ", "B": "BE", "T": "BT", "MT": "MT", "SM": "SM"}
ISIN_REGEX = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
WORD_TRIM = ".,:;!?()[]{}\""
POSITIVE_WORDS = ["beat", "upgrade", "expansion", "merger", "profit", "growth", "approval"]
NEGATIVE_WORDS = ["downgrade", "miss", "fraud", "decline", "probe", "delay", "loss"]
# ----------------------------------------------------------------------------


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Constant map lookup; null for an unknown key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def normalize_identifier(c: Column) -> Column:
    return F.upper(F.trim(c))


def normalize_exchange(c: Column) -> Column:
    code = normalize_identifier(c)
    return F.coalesce(lookup(code, EXCHANGE_SUFFIXES), code)


def split_symbol_exchange(c: Column, exchange: Column | None = None) -> Column:
    """Split at the last dot; an explicit exchange wins over the suffix."""
    given = F.lit(None).cast("string") if exchange is None else normalize_exchange(exchange)
    dotted = c.contains(".")
    suffix = F.when(dotted, F.substring_index(c, ".", -1))
    head = F.when(dotted, F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(c)
    return F.struct(head.alias("symbol"), F.coalesce(given, normalize_exchange(suffix)).alias("exchange"))


def map_series(c: Column, exchange: str) -> Column:
    return lookup(c, NSE_SERIES if exchange == "NSE" else BSE_SERIES)


def snake_case(c: Column) -> Column:
    parts = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2")
    joined = F.regexp_replace(parts, "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(joined, "^_+|_+$", ""))


def truncate_ellipsis(c: Column, n: int = 256) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def record_key(instrument_id: Column, symbol: Column, day: Column, source: Column) -> Column:
    """``id:date:source``, or ``symbol:date`` when the instrument is unknown."""
    none = F.lit("None")
    day_text = F.coalesce(day.cast("string"), none)
    known = F.concat_ws(":", instrument_id.cast("string"), day_text, F.coalesce(source, none))
    unknown = F.concat_ws(":", F.coalesce(F.nullif(symbol, F.lit("")), F.lit("UNKNOWN")), day_text)
    return F.when(instrument_id.isNull(), unknown).otherwise(known)


def yahoo_symbol(symbol: Column, exchange: Column) -> Column:
    suffix = F.when(exchange == "NSE", ".NS").when(exchange == "BSE", ".BO").otherwise("")
    return F.concat(symbol, suffix)


def jsonify_record(**cols: Column) -> Column:
    """Audit text of a record: every value as text, dates in ISO form."""
    return F.to_json(F.struct(*[c.cast("string").alias(k) for k, c in cols.items()]), {"ignoreNullFields": "false"})


def payload_json(**cols: Column) -> Column:
    """JSON payload keeping the given column types."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]), {"ignoreNullFields": "false"})


def input_hash(**cols: Column) -> Column:
    """Stable SHA-256 fingerprint of a metric's identity."""
    return F.sha2(jsonify_record(**cols), 256)


def words(c: Column) -> Column:
    """Distinct lower-case words, outer punctuation stripped."""
    cut = "[" + "".join("\\" + ch for ch in WORD_TRIM) + "]+"
    # a blank at either end would survive as one empty word, which no lexicon holds
    pieces = F.split(c, r"\s+")
    return F.array_distinct(F.transform(pieces, lambda w: F.lower(F.regexp_replace(w, f"^{cut}|{cut}$", ""))))


def keyword_intersection(found: Column, lexicon: list[str]) -> Column:
    """The distinct words of an array that a lexicon holds."""
    return F.array_intersect(found, F.array(*[F.lit(w) for w in lexicon]))


def keyword_score(c: Column, positive: list[str] | None = None, negative: list[str] | None = None) -> Column:
    """Count of distinct positive words minus count of distinct negative words."""
    found = words(c)
    plus, minus = (keyword_intersection(found, lexicon) for lexicon in (positive or POSITIVE_WORDS, negative or NEGATIVE_WORDS))
    return F.size(plus) - F.size(minus)


def valuation_status_text(flag: Column) -> Column:
    return F.when(flag, "Valued").otherwise("Not yet valued")


def first_label_value(*cols: Column) -> Column:
    return F.coalesce(*cols)


def abs_capex(code: Column, value: Column) -> Column:
    return F.when(code == "CAPEX", F.abs(value)).otherwise(value)
