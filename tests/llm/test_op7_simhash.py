import random

import pytest
import xxhash

from tickerlake.llm import op7_simhash as op

SCHEMA = "doc_id long, text string, bits string, component int"


def brute_print(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest reachable id for every fingerprint, over all pairs."""
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def expected(rows):
    prints = {r[1]: brute_print(r[1]) for r in rows}
    label = brute_components(set(prints.values()))
    least = {}
    for i, t, *_ in rows:
        c = label[prints[t]]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return sorted(((i, f"{prints[t]:016x}", least.get(label[prints[t]])) for i, t, *_ in rows), key=str)


def test_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(50):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 400]))]
        for k in range(rng.choice([1, 1, 2, 5])):
            rows.append((i * 10 + k, " ".join(words) + "\n\tEnd" * k, "x", 1))
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, " \x1c", "x", 1), (903, "one", "x", 1), (904, "ONE", "x", 1), (905, "É two", "x", 1), (905, "É two", "x", 1), (None, "é two", "x", 1), (None, "lonely words here now", "x", 1)]
    rows.append((950, "long " * 60_000, "x", 1))
    got = [tuple(r) for r in op.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got, key=str) == expected(rows)
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("large", [1, 5, 64])
def test_links_connect_like_all_pairs(spark, monkeypatch, large):
    from tickerlake.llm.components import components

    monkeypatch.setattr(op, "LARGE", large)
    rng = random.Random(large)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = set(centres)
    for c in centres:
        for _ in range(40):
            x = c
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            prints.add(x)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = {n % (1 << 64): c for n, c in components(op.links(spark.createDataFrame(signed, "bits long"))).collect()}
    mine = {p: found.get(p, p - (1 << 64) if p >> 63 else p) for p in prints}
    label = brute_components(prints)
    groups = lambda m: sorted(sorted(p for p in prints if m[p] == v) for v in set(m.values()))
    assert groups(mine) == groups(label)


def test_keep_one(spark):
    rows = [(3, "a b c d", "x", 1), (1, "a b c d", "y", 2), (1, "a b c d", "y", 2), (7, "other words are here", "z", 3), (None, "q", "n", 4), (None, "q", "n", 4), (8, None, "e", 5), (9, "", "e", 6)]
    kept = op.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "bits", "component"]
    assert sorted(kept.collect(), key=str) == sorted([(1, "a b c d", "y", 2), (7, "other words are here", "z", 3), (8, None, "e", 5), (None, "q", "n", 4)], key=str)


def test_keep_one_of_rows_that_share_an_id(spark):
    clean = [(1, "a clean text of its own", "a", 1), (1, "quite another one with more words in it", "b", 2), (1, "a clean text of its own", "c", 3), (5, "quite another one with more words in it", "d", 4)]
    got = [sorted((tuple(r) for r in op.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) for rows in (clean, clean[::-1])]
    assert got[0] == got[1] and [r[:2] for r in got[0]] == [(1, clean[0][1]), (1, clean[1][1])]


def test_bits_counted_in_parts(monkeypatch):
    rng = random.Random(9)
    texts = ["", "one two three four", *(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)) for n in (1, 900, 3, 40)), " \n"]
    want = [brute_print(t) for t in texts]
    for counted in (1 << 18, 7, 1):
        monkeypatch.setattr(op, "COUNTED", counted)
        assert op.simhash(texts).view("uint64").tolist() == want
