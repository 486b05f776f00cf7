import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickerlake.operators import aliases, identity, timejoin

D = dt.date


@pytest.fixture(scope="module")
def refs(spark):
    comp = spark.createDataFrame([(1, "u1", "INE154A01025"), (2, "u2", "INE002A01018"), (3, "u3", None)], "company_id long, company_uuid string, isin_primary string")
    inst = spark.createDataFrame(
        [(10, 1, 1, "ITC", None, None), (11, 1, 2, "ITC", None, None), (20, 2, 1, "RELIANCE", D(2000, 1, 1), D(2024, 6, 30)), (30, 3, 1, "NEWBN", D(2020, 1, 1), None)],
        "instrument_id long, company_id long, exchange_id int, symbol string, listing_date date, delisting_date date")
    exch = spark.createDataFrame([(1, "NSE"), (2, "BSE")], "exchange_id int, exchange_code string")
    alias = spark.createDataFrame(
        [(1, 10, "NSE", "ITC.NS", D(2000, 1, 1), None), (2, 30, "NSE", "OLDBN", D(2000, 1, 1), D(2024, 3, 31)), (3, 30, "NSE", "NEWBN", D(2024, 4, 1), None), (4, 11, "BSE", "500875", D(2000, 1, 1), None)],
        "alias_id long, instrument_id long, source_system string, alias_symbol string, valid_from date, valid_to date")
    return comp, inst, exch, alias


def cascade(spark, refs, asks):
    rows = spark.createDataFrame(asks, "identifier string, exchange_mic string, as_of date")
    return {(r.identifier, r.exchange_mic): r for r in identity.resolve_cascade(rows, *refs).collect()}


def test_cascade_rules_and_confidence(spark, refs):
    day = D(2024, 5, 1)
    got = cascade(spark, refs, [("ine154a01025", None, day), ("ITC.NS", None, day), ("itc", "BSE", day), ("ITC", None, day), ("ITC.NX", None, day), ("RELIANCE", None, day), ("ZZZZZZZ", None, day)])
    assert (got["ine154a01025", None].instrument_id, got["ine154a01025", None].rule_used, got["ine154a01025", None].confidence_score) == (10, "ISIN_EXACT", 100)
    assert (got["ITC.NS", None].instrument_id, got["ITC.NS", None].matched_input, got["ITC.NS", None].confidence_score) == (10, "ITC.NSE", 95)
    assert got["itc", "BSE"].instrument_id == 11
    # two exchanges without a hint: no ticker match, and the alias is three edits away
    assert got["ITC", None].state == "UNRESOLVED"
    assert (got["ITC.NX", None].rule_used, got["ITC.NX", None].matched_input, got["ITC.NX", None].confidence_score) == ("ALIAS_FUZZY", "ITC.NS", 80)
    assert (got["RELIANCE", None].confidence_score, got["RELIANCE", None].company_uuid) == (90, "u2")
    assert got["ZZZZZZZ", None].state == "UNRESOLVED"


def test_alias_cut_over_and_delisting(spark, refs):
    _, inst, exch, alias = refs
    rows = spark.createDataFrame(
        [("OLDBN", "NSE", D(2024, 3, 31)), ("OLDBN", "NSE", D(2024, 4, 1)), ("RELIANCE", "NS", D(2024, 6, 30)), ("RELIANCE", "NSE", D(2024, 7, 1)), (" itc ", "bo", D(2024, 1, 1))], "symbol string, exchange string, as_of date")
    got = [(r.symbol, r.as_of, r.instrument_id, r.state) for r in identity.resolve_symbol_as_of(rows, inst, exch, alias).orderBy("symbol", "as_of").collect()]
    assert got == [(" itc ", D(2024, 1, 1), 11, "RESOLVED"), ("OLDBN", D(2024, 3, 31), 30, "RESOLVED_ALIAS"), ("OLDBN", D(2024, 4, 1), None, "UNRESOLVED"),
                   ("RELIANCE", D(2024, 6, 30), 20, "RESOLVED"), ("RELIANCE", D(2024, 7, 1), None, "UNRESOLVED")]


def test_ambiguous_symbol(spark, refs):
    _, inst, exch, _ = refs
    twice = inst.unionByName(inst.where("instrument_id = 10").withColumn("instrument_id", F.lit(99).cast("long")))
    rows = spark.createDataFrame([("ITC", "NSE", D(2024, 1, 1))], "symbol string, exchange string, as_of date")
    r = identity.resolve_symbol_as_of(rows, twice, exch).head()
    assert r.state == "AMBIGUOUS" and r.instrument_id is None


def test_deletion_keys_find_every_pair_within_two_edits(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("ABC.") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    ids = spark.createDataFrame([(n,) for n in names[:30]], "_id string")
    others = spark.createDataFrame([(n,) for n in names[30:]], "_name string")
    got = {(r._id, r._name): r.distance for r in identity._near_pairs(ids, others).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    assert got == {(a, b): lev(a, b) for a in set(names[:30]) for b in set(names[30:]) if lev(a, b) <= 2}


def test_hot_symbol_spans_count_without_pairs(spark):
    spans = spark.range(2000).selectExpr("id as i", "case when id % 3 = 0 then 'HOT' else concat('s', id) end as k", "date_add(date'2020-01-01', cast(id % 50 as int)) as f", "date_add(date'2020-02-01', cast(id % 50 as int)) as t")
    points = spark.createDataFrame([("HOT", D(2020, 1, 1)), ("HOT", D(2020, 2, 1)), ("s1", D(2020, 1, 2)), ("s1", D(2020, 1, 1))], "k string, d date")
    got = {(r.k, r.d): (r.n_active, r.i) for r in timejoin.active_unique(points, spans, ["k"], "d", "f", "t", "i").collect()}
    hot = [i for i in range(2000) if i % 3 == 0]
    assert got["HOT", D(2020, 1, 1)][0] == sum(i % 50 == 0 for i in hot)
    assert got["HOT", D(2020, 2, 1)][0] == sum(i % 50 <= 31 for i in hot)
    assert got["s1", D(2020, 1, 2)] == (1, 1) and got["s1", D(2020, 1, 1)] == (0, None)


def test_alias_mutations(spark, refs):
    _, inst, _, alias = refs
    muts = spark.createDataFrame([
        (1, "CREATE", 100, 20, "nse", "reli", D(2020, 1, 1), None), (2, "CREATE", 101, 20, "NSE", "OLDBN", D(2024, 3, 31), None), (3, "CREATE", 102, 20, "NSE", "OLDBN", D(2024, 4, 1), None),
        (4, "CREATE", 103, 77, "NSE", "X", D(2024, 4, 1), None), (5, "CREATE", 104, 20, "FEED", "X", D(2024, 4, 1), None), (6, "CLOSE", 1, None, None, None, None, D(1999, 1, 1)),
        (7, "CLOSE", 4, None, None, None, None, D(2024, 1, 1)), (8, "UPDATE", 55, 20, "NSE", "X", D(2024, 1, 1), None), (9, "UPDATE", 3, 30, "NSE", "NEWBN", D(2024, 4, 2), None),
        (10, "CREATE", 105, 10, "BSE", "TWIN", D(2024, 1, 1), None), (11, "CREATE", 106, 11, "BSE", "TWIN", D(2024, 1, 1), None)],
        "seq long, op string, alias_id long, instrument_id long, source_system string, alias_symbol string, valid_from date, valid_to date")
    table, errors = aliases.merge_aliases(alias, muts, inst)
    assert {r.seq: r.error for r in errors.collect()} == {2: "ALIAS_CONFLICT", 4: "INSTRUMENT_NOT_FOUND", 5: "UNSUPPORTED_SOURCE", 6: "REVERSED_WINDOW", 8: "ALIAS_NOT_FOUND", 11: "ALIAS_CONFLICT"}
    rows = {r.alias_id: r for r in table.collect()}
    assert set(rows) == {1, 2, 3, 4, 100, 102, 105}
    assert rows[4].valid_to == D(2024, 1, 1) and rows[3].valid_from == D(2024, 4, 2) and rows[100].alias_symbol == "RELI"
