"""Point-in-time symbol resolution: exact, alias, ISIN, ticker and fuzzy.

Each resolver turns the reference tables into stretches of days by symbol or text, in which the answer stays the
same; rows meet them by an equi join, so that no window runs over rows and adaptive execution splits a hot key.
"""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tickerlake.functions import dates, text
from tickerlake.operators import timejoin

# --- fixed values -----------------------------------------------------------
ALIAS_SOURCES = ["NSE", "BSE", "BSE_SME", "ISIN", "BLOOMBERG", "REFINITIV"]
MAX_DISTANCE = 2
ANY_EXCHANGE = "*"
# ----------------------------------------------------------------------------


def _life(df: DataFrame) -> DataFrame:
    return df.withColumn("_from", dates.open_start(F.col("listing_date"))).withColumn("_to", dates.open_end(F.col("delisting_date")))


def _symbol_spans(instruments: DataFrame, exchanges: DataFrame) -> DataFrame:
    return (
        _life(instruments.join(exchanges.select("exchange_id", "exchange_code"), "exchange_id"))
        .select(F.upper("symbol").alias("_sym"), F.col("exchange_code").alias("_ex"), "instrument_id", "_from", "_to")
        .where("_from <= _to")
    )


def _alias_spans(aliases: DataFrame, instruments: DataFrame) -> DataFrame:
    """Alias windows cut to the listing life of their instrument."""
    return (
        _life(aliases.join(instruments.select("instrument_id", "exchange_id", "listing_date", "delisting_date"), "instrument_id"))
        .withColumn("_from", F.greatest("_from", "valid_from"))
        .withColumn("_to", F.least("_to", dates.open_end(F.col("valid_to"))))
        .where("_from <= _to")
    )


def resolve_alias_as_of(rows: DataFrame, instruments: DataFrame, exchanges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add instrument_id and state by alias windows alone (exactly one must be open)."""
    keyed = _keyed(rows)
    open_now = timejoin.active_segments({"": _alias_symbol_spans(aliases, instruments, exchanges)}, ["_sym", "_ex"], "_from", "_to", "instrument_id")
    return timejoin.at_segment(keyed, open_now, ["_sym", "_ex"], "as_of").withColumn(
        "state", F.when(F.col("n_active") == 1, "RESOLVED").otherwise("UNRESOLVED")
    ).drop("_sym", "_ex", "n_active")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_sym", text.normalize_identifier(F.col("symbol"))).withColumn("_ex", text.normalize_exchange(F.col("exchange")))


def _alias_symbol_spans(aliases: DataFrame, instruments: DataFrame, exchanges: DataFrame) -> DataFrame:
    return _alias_spans(aliases, instruments).join(exchanges.select("exchange_id", "exchange_code"), "exchange_id").select(
        F.upper("alias_symbol").alias("_sym"), F.col("exchange_code").alias("_ex"), "instrument_id", "_from", "_to"
    )


def resolve_symbol_as_of(rows: DataFrame, instruments: DataFrame, exchanges: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Add instrument_id and state for (symbol, exchange, as_of).

    Exactly one listed instrument wins; several are ambiguous; none falls back to
    the alias windows, of which again exactly one must be open.
    """
    # listed symbols and aliases are two kinds of spans of one pass
    sides = {"": _symbol_spans(instruments, exchanges)}
    if aliases is not None:
        sides["_alias"] = _alias_symbol_spans(aliases, instruments, exchanges)
    spans = timejoin.active_segments(sides, ["_sym", "_ex"], "_from", "_to", "instrument_id")
    if aliases is None:
        spans = spans.withColumn("instrument_id_alias", F.lit(None).cast("long")).withColumn("n_active_alias", F.lit(0))
    answer = spans.select(
        "_sym", "_ex", "_since", "_until",
        F.when(F.col("n_active") > 1, F.lit(None)).otherwise(F.coalesce("instrument_id", "instrument_id_alias")).alias("instrument_id"),
        F.when(F.col("n_active") == 1, "RESOLVED")
        .when(F.col("n_active") > 1, "AMBIGUOUS")
        .when(F.col("n_active_alias") == 1, "RESOLVED_ALIAS")
        .otherwise("UNRESOLVED").alias("state"),
    )
    return timejoin.at_segment(_keyed(rows), answer, ["_sym", "_ex"], "as_of").withColumn(
        "state", F.coalesce("state", F.lit("UNRESOLVED"))
    ).drop("_sym", "_ex")


def _isin_segments(companies: DataFrame, instruments: DataFrame) -> DataFrame:
    """(_id, _since, _until, instrument_id): the lowest listed instrument of an ISIN between two days on which its listings change."""
    spans = (
        _life(instruments.join(companies.select("company_id", "isin_primary"), "company_id"))
        .withColumn("_id", F.upper("isin_primary")).where(F.col("_id").rlike(text.ISIN_REGEX) & (F.col("_from") <= F.col("_to")))
        .groupBy("_id", "_from", "_to").agg(F.min("instrument_id").alias("instrument_id"))
    )
    closed = spans.where(F.col("_to") < F.lit(dates.OPEN_END).cast("date"))
    edges = spans.select("_id", F.col("_from").alias("_since")).union(closed.select("_id", F.date_add("_to", 1))).distinct()
    edges = edges.withColumn("_until", F.lead("_since").over(W.partitionBy("_id").orderBy("_since")))
    return edges.join(spans, "_id").where("_since between _from and _to").groupBy("_id", "_since", "_until").agg(F.min("instrument_id").alias("instrument_id"))


def _with_company(hits: DataFrame, instruments: DataFrame, companies: DataFrame) -> DataFrame:
    uuids = instruments.select("instrument_id", "company_id").join(companies.select("company_id", "company_uuid"), "company_id").drop("company_id")
    return hits.join(uuids, "instrument_id", "left")


def resolve_isin(rows: DataFrame, companies: DataFrame, instruments: DataFrame) -> DataFrame:
    """Add the ISIN match of (identifier, as_of): lowest instrument, confidence 100."""
    keyed = rows.withColumn("_id", text.normalize_identifier(F.col("identifier")))
    listed = _with_company(_isin_segments(companies, instruments), instruments, companies)
    return timejoin.at_segment(keyed, listed, ["_id"], "as_of").withColumns(
        {
            "rule_used": F.when(F.col("instrument_id").isNotNull(), "ISIN_EXACT"),
            "confidence_score": F.when(F.col("instrument_id").isNotNull(), 100),
        }
    ).drop("_id")


def _ticker_segments(instruments: DataFrame, exchanges: DataFrame) -> DataFrame:
    """(_sym, _ex, _since, _until, instrument_id): while the ticker has one listed instrument, on an exchange or anywhere."""
    spans = _symbol_spans(instruments, exchanges)
    spans = spans.unionByName(spans.withColumn("_ex", F.lit(ANY_EXCHANGE)))
    return timejoin.active_segments({"": spans}, ["_sym", "_ex"], "_from", "_to", "instrument_id").where("n_active = 1").drop("n_active")


def _ticker_parts(keyed: DataFrame) -> DataFrame:
    """Add the symbol and the exchange (or any) that an identifier asks for."""
    parts = text.split_symbol_exchange(F.col("_id"), F.nullif(F.col("_mic"), F.lit("")))
    return keyed.withColumn("_p", parts).withColumn("_sym", F.col("_p.symbol")).withColumn("_ex", F.coalesce("_p.exchange", F.lit(ANY_EXCHANGE))).drop("_p")


def resolve_ticker_exact(rows: DataFrame, companies: DataFrame, instruments: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Add the exact ticker match of (identifier, exchange_mic, as_of)."""
    listed = _with_company(_ticker_segments(instruments, exchanges), instruments, companies).withColumns(_ticker_columns())
    return timejoin.at_segment(_ticker_parts(_asked(rows)), listed, ["_sym", "_ex"], "as_of").drop("_id", "_mic", "_sym", "_ex")


def _ticker_columns() -> dict[str, Column]:
    anywhere = F.col("_ex") == ANY_EXCHANGE
    return {
        "rule_used": F.lit("TICKER_EXACT"),
        "confidence_score": F.when(anywhere, 90).otherwise(95),
        "matched_input": F.when(anywhere, F.col("_sym")).otherwise(F.concat_ws(".", "_sym", "_ex")),
        "source_provenance": F.when(anywhere, "ref_instrument.symbol").otherwise(
            F.concat(F.lit("ref_instrument.symbol+ref_exchange.exchange_code="), F.col("_ex"))
        ),
    }


def _asked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_id", text.normalize_identifier(F.col("identifier"))).withColumn(
        "_mic", F.coalesce(F.upper(F.trim("exchange_mic")), F.lit(""))
    )


def segment_keys(c: Column, own: bool) -> Column:
    """Keys (length of a name, segment, text of the segment): of a name itself, or of all names that a text may be near.

    A name is cut into one segment more than there may be edits, so that two texts within the edit distance share one
    unchanged, moved by as many places at most.  The number of keys does not grow with a text's length.
    """
    parts, length = MAX_DISTANCE + 1, F.length(c)
    shifts = [0] if own else range(-MAX_DISTANCE, MAX_DISTANCE + 1)
    # (letters more than the text has, segment, places moved), a constant
    cases = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("mps", case))) for case in itertools.product(shifts, range(parts), shifts)))

    def edge(x: Column, segment: Column) -> Column:
        return F.floor((length + x.m) * segment / parts).cast("int")

    inside = F.filter(cases, lambda x: (length + x.m >= 0) & (edge(x, x.p) + x.s >= 0) & (edge(x, x.p + 1) + x.s <= length))
    keys = F.transform(inside, lambda x: F.struct((length + x.m).alias("_size"), x.p.alias("_part"), F.substring(c, edge(x, x.p) + x.s + 1, edge(x, x.p + 1) - edge(x, x.p)).alias("_text")))
    return F.array_distinct(keys)


def _near_pairs(ids: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (_id, _name) text pairs within the edit distance, with distance."""
    b = names.select("_name").distinct()
    # only texts as long as some name, give or take the edit distance, get keys
    reach = b.select(F.explode(F.array(*(F.length("_name") + k for k in range(-MAX_DISTANCE, MAX_DISTANCE + 1)))).alias("_len")).distinct()
    a = ids.select("_id").distinct().withColumn("_len", F.length("_id")).join(reach, "_len", "left_semi").drop("_len")
    a = a.select("_id", F.inline(segment_keys(F.col("_id"), False)))
    b = b.select("_name", F.inline(segment_keys(F.col("_name"), True)))
    return (
        a.join(b, ["_size", "_part", "_text"]).select("_id", "_name").distinct()
        .withColumn("distance", F.levenshtein(F.col("_id"), F.col("_name"), MAX_DISTANCE))
        .where("distance >= 0")
    )


def _nearest_segments(ids: DataFrame, aliases: DataFrame, instruments: DataFrame) -> DataFrame:
    """(_id, _since, _until, distance, n_best, alias_id): between days on which an alias near the text opens or ends, the
    least distance, how many aliases have it, and the alias if just one has."""
    spans = _alias_spans(aliases, instruments).select(text.normalize_identifier(F.col("alias_symbol")).alias("_name"), "alias_id", "_from", "_to")
    # aliases at each distance are a kind of spans of the text
    near = _near_pairs(ids, spans).join(spans, "_name").withColumn("_kind", F.col("distance").cast("string"))
    found = timejoin.segments_by_kind(near, [str(d) for d in range(MAX_DISTANCE + 1)], ["_id"], "_from", "_to", "alias_id")

    def pick(of: Callable[[int], Column]) -> Column:
        return F.coalesce(*[F.when(F.col(f"n_active{d}") > 0, of(d)) for d in range(MAX_DISTANCE + 1)])

    n_best = pick(lambda d: F.col(f"n_active{d}"))
    alias = reduce(lambda rest, d: F.when(F.col(f"n_active{d}") > 0, F.col(f"alias_id{d}")).otherwise(rest), reversed(range(MAX_DISTANCE + 1)), F.lit(None))
    return found.select("_id", "_since", "_until", pick(F.lit).alias("distance"), n_best.alias("n_best"), alias.alias("alias_id"))


def best_match_rank(points: DataFrame, aliases: DataFrame, instruments: DataFrame) -> DataFrame:
    """(_id, as_of, distance, n_best, alias_id) of the aliases open on the day that are nearest to each text: the
    least distance, how many aliases have it, and the alias if just one has."""
    asked = points.select("_id", "as_of").where("as_of is not null").distinct()
    return timejoin.at_segment(asked, _nearest_segments(points, aliases, instruments), ["_id"], "as_of").where("n_best > 0")


def _fuzzy_columns(hits: DataFrame, aliases: DataFrame) -> DataFrame:
    detail = aliases.select("alias_id", "instrument_id", F.col("alias_symbol").alias("matched_input"), "source_system")
    return hits.join(detail, "alias_id", "left").select(
        "_id", "_since", "_until", "instrument_id", "matched_input", "n_best", "distance",
        F.concat(F.lit("ref_symbol_alias.source_system="), F.col("source_system")).alias("source_provenance"),
        F.when(F.col("n_best") == 1, F.when(F.col("distance") == 0, 90).otherwise(F.greatest(F.lit(70), 90 - F.col("distance") * 10))).alias("confidence_score"),
    )


def resolve_fuzzy_alias(rows: DataFrame, aliases: DataFrame, instruments: DataFrame, companies: DataFrame) -> DataFrame:
    """Add the nearest alias within distance two; a tie at the best is ambiguous."""
    keyed = rows.withColumn("_id", text.normalize_identifier(F.col("identifier")))
    nearest = _with_company(_fuzzy_columns(_nearest_segments(keyed, aliases, instruments), aliases), instruments, companies)
    return timejoin.at_segment(keyed, nearest, ["_id"], "as_of").withColumn(
        "state",
        F.when(F.col("n_best") == 1, "MATCHED").when(F.col("n_best") > 1, "AMBIGUOUS").otherwise("UNRESOLVED"),
    ).drop("_id", "n_best")


def resolve_cascade(rows: DataFrame, companies: DataFrame, instruments: DataFrame, exchanges: DataFrame, aliases: DataFrame) -> DataFrame:
    """ISIN, then ticker, then fuzzy alias for (identifier, exchange_mic, as_of).

    Each resolver is a table of stretches of days by its key; rows meet them one after the other, and those by the
    identifier share an exchange.  What is looked for by distance is each distinct text once.
    """

    def named(side: DataFrame, prefix: str) -> DataFrame:
        keys = ["_id", "_sym", "_ex", "_since", "_until", "n_best"]
        return side.select(*[F.col(c).alias(c if c in keys else f"_{prefix}_{c}") for c in side.columns])

    asked = _asked(rows)
    ticker = _with_company(_ticker_segments(instruments, exchanges), instruments, companies).withColumns(_ticker_columns())
    isin = _with_company(_isin_segments(companies, instruments), instruments, companies)
    nearest = _with_company(_fuzzy_columns(_nearest_segments(asked, aliases, instruments), aliases), instruments, companies)
    full = timejoin.at_segment(_ticker_parts(asked), named(ticker, "t"), ["_sym", "_ex"], "as_of")
    full = timejoin.at_segment(full, named(isin, "i"), ["_id"], "as_of")
    full = timejoin.at_segment(full, named(nearest.drop("distance"), "f"), ["_id"], "as_of")
    first, second, third = F.col("_i_instrument_id").isNotNull(), F.col("_t_instrument_id").isNotNull(), F.col("n_best") == 1

    def choose(a: Column, name: str) -> Column:
        return F.when(first, a).when(second, F.col(f"_t_{name}")).when(third, F.col(f"_f_{name}")).alias(name)

    return full.select(
        *rows.columns,
        choose(F.col("_i_instrument_id"), "instrument_id"),
        F.when(first, "ISIN_EXACT").when(second, "TICKER_EXACT").when(third, "ALIAS_FUZZY").alias("rule_used"),
        choose(F.lit(100), "confidence_score"),
        choose(F.col("_id"), "matched_input"),
        choose(F.lit("ref_company.isin_primary"), "source_provenance"),
        F.when(first | second | third, "MATCHED").when(F.col("n_best") > 1, "AMBIGUOUS").otherwise("UNRESOLVED").alias("state"),
        choose(F.col("_i_company_uuid"), "company_uuid"),
    )


def alias_conflicts(aliases: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add ``conflicts``: overlapping windows of the same (source, alias symbol)
    that point to another instrument.  A row being updated does not meet itself."""
    key = ["source_system", "alias_symbol"]
    same = timejoin.overlap_counts(incoming, {"_all": (aliases, key), "_same": (aliases, [*key, "instrument_id"])})
    return _less_self(same, aliases)


def _less_self(same: DataFrame, aliases: DataFrame) -> DataFrame:
    """``conflicts`` from the counts, without the stored form of the row itself."""
    own = aliases.select(
        F.col("alias_id"), F.col("source_system").alias("_os"), F.col("alias_symbol").alias("_oa"), F.col("instrument_id").alias("_oi"),
        F.col("valid_from").alias("_of"), dates.open_end(F.col("valid_to")).alias("_ot"),
    )
    meets_self = (
        (F.col("_os") == F.col("source_system")) & (F.col("_oa") == F.col("alias_symbol")) & (F.col("_oi") != F.col("instrument_id"))
        & (F.col("_of") <= dates.open_end(F.col("valid_to"))) & (F.col("valid_from") <= F.col("_ot"))
    )
    return same.join(own, "alias_id", "left").withColumn(
        "conflicts", F.col("_all") - F.col("_same") - F.when(meets_self, 1).otherwise(0)
    ).drop("_all", "_same", "_os", "_oa", "_oi", "_of", "_ot")


def active_aliases(aliases: DataFrame, as_of: dt.date) -> DataFrame:
    return aliases.where(F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(as_of)))


def bse_isin_map(aliases: DataFrame, instruments: DataFrame, companies: DataFrame) -> DataFrame:
    """BSE alias -> ISIN for the BSE file reader."""
    return (
        aliases.where("source_system = 'BSE'")
        .join(instruments.select("instrument_id", "company_id"), "instrument_id")
        .join(companies.where("isin_primary is not null").select("company_id", "isin_primary"), "company_id")
        .select("alias_symbol", "isin_primary")
    )
