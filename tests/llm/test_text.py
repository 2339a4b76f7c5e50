"""Personal data, winnowing, near duplicates and quality against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import components, neardup, pii, quality, winnow

# -- personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def sound(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in p.finditer(text) if sound(kind, m[0])]
    return sorted(found)


def told(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def luhn_number(rng, n):
    body = [rng.randrange(10) for _ in range(n - 1)]
    total = sum(d * 2 - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(body)))
    return "".join(map(str, body)) + str(-total % 10)


def noisy_texts(n=500):
    rng = random.Random(11)
    parts = [
        "a", "Z9", ".", "..", "@", "-", "+", " ", "  ", "_", "%", "(", ")", ",", "\n", "é", "😀", "", "1", "255", "256", "0", "007", "192.168.0.1", "1.2.3.4.5.6.7.8", "x@y.z", "a.b+c@d-e.f.g", "@b.c",
        "+49 (0) 30 1234567", "+1.2", "4111 1111 1111 1111", "4111-1111-1111-1112", "12", "3456789", "1.2.3.4444", "a@b", "a@b.", "user@host.com", "999.1.1.1", "١٢٣", "-1", "00000000000000000000", "+123456789012345", "+1234567890123456",
    ]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n)]
    out += [f"card {luhn_number(rng, k)} and {'-'.join(luhn_number(rng, k))}" for k in range(10, 22)]
    return out + ["1" * 3_000, "1 " * 2_000, "a." * 2_000 + "@" + "b." * 2_000 + "c", "+1" + "2 " * 2_000, "1." * 3_000, "@" * 3_000, "a@" * 2_000]


def test_base_spans_equal_the_rules(spark, odd, none, data):
    texts = noisy_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = docs.unionByName(odd.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text")).unionByName(spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id") + 200_000, "text").toDF("doc_id", "text"))
    inputs = docs.collect()
    got = pii.find(docs).collect()
    key = lambda i, sha: (i if i is not None else -1, sha)
    want = []
    for r in inputs:
        spans = base_spans(r["text"] or "")
        counts = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
        want.append((key(r["doc_id"], hashlib.sha256(told(spans).encode()).hexdigest()), counts, spans))
    have = {}
    for r in got:
        have.setdefault(key(r["doc_id"], r["base_sha256"]), []).append(r)
    assert len(got) == len(want)
    for k, counts, spans in want:
        r = have[k][0]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        every = [s for s in r["spans"].split(",") if s]
        assert set(filter(None, told(spans).split(","))) <= set(every)
        assert every == sorted(every, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0]), int(s.split(":")[2])))
    assert pii.find(none).count() == 0


def contextual(spark):
    rng = random.Random(2)
    rows = [(i, f"{rng.choice(['Hallo', 'note', 'old'])} {i} my phone is +49 30 {rng.randrange(10**6, 10**7)} thanks and goodbye") for i in range(30)]
    rows += [(100, "so my phone is 030-555-0199 thanks"), (101, "see my phone is 030/1234 thanks"), (102, "version 12.3.4-beta5 was released")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_discover_unseen_identifiers(spark):
    docs = contextual(spark)
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kind, start, end = got[100]["spans"].split(":")
    assert kind == "phone" and text[100][int(start) : int(end)] == "030-555-0199" and got[100]["n_phone"] == 0
    assert got[102]["spans"] == "" and all(got[i]["n_phone"] == 1 for i in range(30))


def brute_patterns(seen, support=pii.SUPPORT, rounds=pii.ROUNDS, confident=pii.CONFIDENT):
    """{pattern: (kind, score)} by plain loops. ``seen``: (pattern, value, kind or None)."""
    kinds, members = {}, defaultdict(set)
    for p, v, k in seen:
        members[p].add(v)
        if k is not None:
            kinds[p, v] = min(k, kinds.get((p, v), k))
    accepted = {}
    for turn in range(rounds):
        scores = {}
        for p, values in members.items():
            best = None
            for k in range(4):
                own = [1.0 if (p, v) in kinds else accepted[v][1] for v in values if (kinds.get((p, v), accepted.get(v, (None,))[0])) == k]
                n = sum(c >= confident for c in own)
                if n >= support and (best is None or sum(own) / len(values) * (1 - 1 / (n + 1)) > best[1]):
                    best = (k, sum(own) / len(values) * (1 - 1 / (n + 1)))
            if best:
                scores[p] = best
        if turn == rounds - 1:
            return {p: b for p, b in scores.items() if b[1] >= confident}
        reached = {}
        for p, (k, s) in scores.items():
            for v in members[p]:
                if (p, v) not in kinds and (v not in reached or (s, -k) > (reached[v][1], -reached[v][0])):
                    reached[v] = (k, s)
        accepted = {v: b for v, b in reached.items() if b[1] >= confident}


@pytest.mark.parametrize("seed", range(3))
def test_pattern_graph_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    seen = []
    for p in range(60):
        kind = rng.randrange(4)
        for _ in range(rng.choice([1, 5, 8, 12])):
            v = rng.randrange(120)
            seen.append((p, v, (kind if rng.random() < 0.85 else rng.randrange(4)) if rng.random() < (0.8 if p < 30 else 0.1) else None))
    got = pii.trusted_patterns(spark.createDataFrame(seen, "pattern long, value long, kind int"), support=3, confident=0.6).collect()
    want = brute_patterns(seen, support=3, confident=0.6)
    assert {r["pattern"]: (r["kind"], round(r["score"], 9)) for r in got} == {p: (k, round(s, 9)) for p, (k, s) in want.items()} != {}


def test_discovered_identifiers_induce_patterns_of_their_own(spark):
    """No base match ever stands after 'ref code': only what 'my phone is' discovered does, and from there on others."""
    rows = [(i, f"my phone is +49 30 {1_000_000 + 7919 * i} thanks") for i in range(1_000, 1_200)]
    rows += [(100 + i, f"my phone is 030-55-{i:03} thanks") for i in range(20)]
    rows += [(200 + i, f"ref code: 030-55-{i:03} noted") for i in range(20)] + [(300, "ref code: 030/99 noted"), (301, "ref code: 777-88-99 noted"), (302, "another ref: 777-88-98 seen")]
    rows.append((400, "my phone is " + "1a" * 3_000 + "... thanks"))  # however long, without the marks at its end
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert got[100]["spans"] == "phone:12:22" and got[200]["spans"] == "phone:10:20" and got[301]["spans"] == "phone:10:19"
    assert got[300]["spans"] == got[302]["spans"] == "" and got[400]["spans"] == "phone:12:6012" and got[301]["n_spans"] == 1
    # By brute force from the same positions, and not with a single turn.
    seen = [(p, s["value"], s["kind"]) for r in pii.positions(docs).collect() for s in r["seen"] for p in s["patterns"]]
    want = {p: (k, round(s, 9)) for p, (k, s) in brute_patterns(seen).items()}
    table = spark.createDataFrame(seen, "pattern long, value long, kind int")
    assert {r["pattern"]: (r["kind"], round(r["score"], 9)) for r in pii.trusted_patterns(table).collect()} == want
    assert pii.trusted_patterns(table, rounds=1).count() < len(want)


def test_places_of_very_many_matches(spark):
    text = "é1 a@b.cd " * 20_000
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(pii.matches(F.col("t"), "[0-9]").alias("m")).collect()
    assert [(m["start"], m["end"]) for m in got[0]["m"]] == [(10 * i + 1, 10 * i + 2) for i in range(20_000)] and got[1]["m"] == []


def test_redaction_keeps_rows_and_columns(spark, odd, none):
    docs = contextual(spark).withColumn("digest", F.lit("mine")).withColumn("every", F.lit(1))
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).schema.names == docs.schema.names and out[100]["digest"] == "mine"
    assert out[100]["text"] == "so my phone is [PHONE] thanks" and out[102]["text"] == "version 12.3.4-beta5 was released"
    line = "a@b.cd, +1 (2) 345678901; 10.0.0.1, 4111 1111 1111 1111 é"
    mixed = spark.createDataFrame([(1, line), (2, None), (1, line), (None, "x@y.zz"), (3, "call +49 30 10.0.0.12 now"), (4, "+1 (2) 345678901 10.0.0.1 4111 1111 1111 1111 é")], "doc_id long, text string")
    # The fourth text's phone has too many digits and its card a wrong check digit, as the rules match on: neither is retried.
    want = [(1, "[EMAIL], [PHONE]; [IP], [CARD] é")] * 2 + [(2, None), (3, "call [PHONE] now"), (4, "+1 (2) 345678901 [IP] 4111 1111 1111 1111 é"), (None, "[EMAIL]")]
    assert sorted(map(tuple, pii.redact(mixed).collect()), key=str) == sorted(want, key=str)
    assert [told(base_spans(t)) for t in ("call +49 30 10.0.0.12 now", "+1 (2) 345678901 10.0.0.1 4111 1111 1111 1111 é")] == ["phone:5:21,ip:12:21", "ip:17:25"]
    same = lambda df: sorted(map(str, df.collect()))
    clean = odd.where("text is null or not text rlike '[0-9]'")
    assert same(pii.redact(clean)) == same(clean) and pii.redact(odd).count() == odd.count() and pii.redact(none).count() == 0


# -- winnowing


def brute_fingerprint(grams, window):
    """(place, hash) of the chosen grams: the rightmost least one of every window."""
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        part = list(enumerate(grams[i : i + window], i))
        if part:
            best = min(part, key=lambda x: (x[1], -x[0]))
            if best not in out:
                out.append(best)
    return out


def test_winnowing_chooses_the_rightmost_least(spark, odd):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["to", "be", "or", "not", "ça", "x9"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 10, 11, 12, 40, 300)] + ["日本語テキスト mixed 漢字 words", "!!", "a a a a a a a a a a a a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = {r[0]: r[1] for r in docs.select("doc_id", winnow.terms(F.col("text"))).collect()}
    rows = {r["doc_id"]: r for r in winnow.fingerprints(docs).collect()}
    known = spark.createDataFrame([(t,) for t in {x for ts in terms.values() for x in ts}], "t string").select("t", F.shiftrightunsigned(F.xxhash64("t"), 33)).collect()
    of = dict(map(tuple, known))
    by_doc = {i: [sum(h * winnow.BASE ** (winnow.K - 1 - j) for j, h in enumerate([of[t] for t in ts[p : p + winnow.K]])) % winnow.MODULUS for p in range(max(1, len(ts) - winnow.K + 1))] for i, ts in terms.items() if ts}
    for i, text in enumerate(texts):
        r = rows[i]
        assert r["n_chars"] == len(text)
        if terms[i]:
            assert list(zip(r["places"], r["fingerprint"], strict=True)) == brute_fingerprint(by_doc[i], winnow.WINDOW), text
        else:
            assert len(r["fingerprint"]) == bool(text)
    # The guarantee: a shared run of WINDOW + K - 1 terms is a shared hash.
    run = " ".join(f"w{i}" for i in range(winnow.WINDOW + winnow.K - 1))
    a, b = winnow.fingerprints(spark.createDataFrame([(1, f"alpha beta {run} gamma"), (2, f"some other words come first {run}")], "doc_id long, text string")).select("fingerprint").collect()
    assert set(a[0]) & set(b[0])


def check_edits(docs, rows, per_range, coarse=2_000):
    order = {t or "": h for t, h in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect()}
    ordered = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, order[r["text"] or ""]))
    want = []
    for k, r in enumerate(ordered):
        text, after = r["text"] or "", ordered[(k + 1) % len(ordered)]["text"] or ""
        half = len(text) // 2
        want.append((str(r["doc_id"]), len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = winnow.edited_documents(docs, per_range=per_range, coarse=coarse).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    for r in got:
        a, b = (set(re.findall("." * 8, r[c])) for c in ("fingerprint", "edited_fingerprint"))
        assert abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12 and 0 <= r["near_next"] <= 1
    ids = [r["doc_id"] for r in ordered]
    if len(set(ids)) == len(ids):
        prints = {r["doc_id"]: r["fingerprint"] for r in got}
        for r in got:
            a, b = (set(re.findall("." * 8, prints[i])) for i in (r["doc_id"], ids[(ids.index(r["doc_id"]) + 1) % len(ids)]))
            assert abs(r["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


@pytest.mark.parametrize("per_range", [3, 1_000])
def test_edited_documents(spark, odd, none, data, per_range):
    check_edits(odd, odd.collect(), per_range)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check_edits(docs, docs.collect(), per_range * 10)
    check_edits(docs, docs.collect(), 3, coarse=4)  # many ranges from few quantiles
    one = docs.where("doc_id = 5")
    check_edits(one, one.collect(), per_range)
    assert winnow.edited_documents(none, per_range=per_range).count() == 0


def test_ranges_stay_small_whatever_the_ids(spark):
    """Frequent ids, ids far apart and null ids: no range is much larger than it should be, and ranges follow the order."""
    rng = random.Random(6)
    ids = [7] * 4_000 + [None] * 3_000 + [rng.randrange(1 << 62) for _ in range(3_000)] + list(range(2_000)) + [-(1 << 63), (1 << 63) - 1]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    keys = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h")).cache()
    for coarse in (2_000, 40):
        plan = winnow.ranges(keys, 100, coarse)
        at, number = winnow.range_of(F.col("k"), F.col("h"), plan)
        rows = sorted(map(tuple, keys.select("k", "h", at, number).collect()))
        assert all(a[2] <= b[2] and a[3] <= b[3] for a, b in zip(rows, rows[1:], strict=False)) and len(plan.start) <= coarse
        largest = max(Counter(r[3] for r in rows).values())
        assert largest <= (300 if coarse == 2_000 else 700), largest
    check_edits(docs, docs.collect(), 100)


# -- near duplicates


def brute_components(docs, percent=85):
    sets = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def planted_texts():
    rng = random.Random(9)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + str(rng.randrange(300))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 8, 30, 120, 400]))]
        out.append(base)
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 30) + 1)):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    out += [["one", "two"], ["One", "TWO"], ["one"], [], ["é", "É", "x"], ["é", "é", "x"]]
    rng.shuffle(out)
    return [(i * 3, ("  " if i % 5 == 0 else " ").join(w)) for i, w in enumerate(out)]


def test_near_duplicates_equal_brute_force(spark, data, rows_of):
    for docs in (planted_texts(), rows_of("documents", "doc_id, text")):
        df = spark.createDataFrame(docs, "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
        assert got == brute_components(docs)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    docs = planted_texts()
    monkeypatch.setattr(neardup, "BLOCK", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(docs)


def group_of_copies(n, seed=4):
    """A text's near copies: many are close to it but not to each other, some are only close to another copy."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(200)]
    out = [base]
    for k in range(1, n):
        copy = list(base if k % 7 else out[-1])
        for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6])):
            copy[rng.randrange(len(copy))] = word()
        out.append(copy)
    return [(k, " ".join(w)) for k, w in enumerate([*out, *([word() for _ in range(60)] for _ in range(20))])]


@pytest.mark.parametrize("block", [3, 25])
def test_large_groups_are_linked_by_their_hubs_and_the_rest_exactly(spark, monkeypatch, block):
    docs = group_of_copies(160)
    want = brute_components(docs)
    assert 2 < len({c for k, (_, c) in want.items() if k < 160}) < 100  # the hub alone would not do
    monkeypatch.setattr(neardup, "BLOCK", block)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()} == want


def test_rows_of_a_doc_id_are_one_document_whatever_their_texts(spark):
    a, b, c = ("aa bb cc dd ee ff gg", "hh ii jj kk ll mm", "nn oo pp qq rr ss tt uu")
    for x, y, z in ((a, b, c), (a, c, b), (b, a, c), (b, c, a), (c, a, b), (c, b, a)):
        rows = spark.createDataFrame([(5, x), (5, y), (5, z), (3, y), (8, z), (9, "other")], "doc_id long, text string")
        got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(rows).collect()}
        assert got == {(5, 3, False), (3, 3, True), (8, 3, False), (9, 9, True)}


def test_near_duplicates_of_the_next_table_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for percent in (85, 80):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, percent).collect()}
        assert got == brute_components([tuple(r) for r in docs.collect()], percent)


def test_near_duplicates_odd_input(spark, odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and neardup.near_duplicates(none).count() == 0
    for r in got:
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is not null").count() == odd.where("doc_id is not null").select("doc_id").distinct().count() == kept.select("doc_id").distinct().count() - 1
    assert kept.where("doc_id is null").count() == 2 and kept.where("doc_id = 5 and kept_doc_id = 'k'").count() == 1
    assert neardup.deduplicated(none).count() == 0


def test_signatures_and_the_pigeonhole():
    rng = np.random.default_rng(0)
    one = rng.integers(0, 256, neardup.PLACES, dtype=np.uint8)
    keys = set(neardup.bucket_keys(one[None])[0].tolist())
    for _ in range(200):
        other = one.copy()
        places = rng.choice(neardup.PLACES, 2 * neardup.CHUNKS - 1, replace=False)
        other[places] ^= rng.integers(1, 256, len(places), dtype=np.uint8)
        assert keys & set(neardup.bucket_keys(other[None])[0].tolist())
    a = neardup.shingles(" ".join(map(str, range(1000))))
    b = neardup.shingles(" ".join(map(str, range(100, 1100))))
    differ = np.count_nonzero(np.frombuffer(neardup.signature(a), np.uint8) != np.frombuffer(neardup.signature(b), np.uint8))
    assert abs(differ / neardup.PLACES - (1 - 896 / 1096)) < 0.2
    assert (neardup.shingles("A  b\tc\nD e") == neardup.shingles("a b c d e")).all() and len(neardup.shingles(" \n")) == 0
    assert len(neardup.shingles("a\x00b\xa0c")) == 1


def test_pairs_up_to_near_share_a_key():
    rng = np.random.default_rng(2)
    for size in neardup.SIZES.values():
        assert size.near < 2 * size.chunks
        one = rng.integers(0, 256, size.places, dtype=np.uint8)
        keys = set(neardup.bucket_keys(one[None], size.chunks)[0].tolist())
        chunks = np.array_split(np.arange(size.places), size.chunks)
        for _ in range(50):  # the worst case: two places of as many chunks as there can be
            order = rng.permutation(size.chunks)
            places = np.concatenate([rng.choice(chunks[c], 2, replace=False) for c in order])[: size.near]
            other = one.copy()
            other[places] ^= rng.integers(1, 256, len(places), dtype=np.uint8)
            assert keys & set(neardup.bucket_keys(other[None], size.chunks)[0].tolist())


def test_components_of_any_graph(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    mixed = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    links = chain + star + mixed + [(5, 5), (7, None), (None, None), (0, 1), (1, 0)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    up = {}
    root = lambda k: k if up.setdefault(k, k) == k else root(up[k])
    for a, b in links:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- quality


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in quality.op8_quality(spark, d).collect()}
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum(a > b for a in ones for b in zeros) / (len(ones) * len(zeros)) > 0.97
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.95


def test_quality_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    same = defaultdict(set)
    for r, t in zip(got, odd.collect(), strict=True):
        same[t["text"] or ""].add(r["score"])
    assert all(len(s) == 1 for s in same.values())
    assert quality.classify(none, labels).count() == 0
    empty = quality.classify(odd, labels.where("false")).collect()
    assert len({r["score"] for r in empty}) == 1
    model = quality.train(odd, labels)
    accepted = quality.accepted(odd, model)
    assert accepted.columns == odd.columns and accepted.count() == sum(r["predicted"] for r in got)


def test_descent_is_the_gradient_of_the_risk():
    rng = np.random.default_rng(2)
    for case in range(12):
        f, h = 5, 3
        layers = [rng.normal(0, 1, (f, h)), rng.normal(0, 1, h), rng.normal(0, 2, h), rng.normal(0, 1, 1)]
        xp, xu, prior = rng.normal(0.5, 1, (7, f)), rng.normal(-1 if case % 2 else 0, 1, (9, f)), (0.3, 0.95)[case % 2]
        # By hand: the sigmoid loss of both parts.
        s = lambda x: 1 / (1 + np.exp(-(np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3][0])))  # noqa: E731, B023
        one, two = quality.risk(layers, xp, xu, prior)
        assert abs(one - prior * np.mean(1 - s(xp))) < 1e-12 and abs(two - (np.mean(s(xu)) - prior * np.mean(s(xp)))) < 1e-12
        value = lambda: (sum(quality.risk(layers, xp, xu, prior)) if two >= 0 else -quality.risk(layers, xp, xu, prior)[1])  # noqa: E731, B023
        for layer, gradient in zip(layers, quality.descent(layers, xp, xu, prior), strict=True):
            for at in np.ndindex(layer.shape):
                old, step = layer[at], 1e-6
                layer[at] = old + step
                up = value()
                layer[at] = old - step
                down = value()
                layer[at] = old
                assert abs((up - down) / (2 * step) - gradient[at]) < 1e-7


def test_a_repeated_doc_id_counts_once_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "good text here")] * 500 + [(k, f"text {k} !!") for k in range(2, 40)], "doc_id long, text string")
    once = spark.createDataFrame([(1, "good text here")] + [(k, f"text {k} !!") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, quality int")
    a, b = quality.train(docs, labels), quality.train(once, labels)
    assert (a.mean == b.mean).all() and all((x == y).all() for x, y in zip(a.layers, b.layers, strict=True))


def test_risk_is_not_negative_and_learns():
    rng = np.random.default_rng(1)
    f = quality.FEATURES
    good, bad = rng.normal(1, 1, (400, f)), rng.normal(-1, 1, (400, f))
    model = quality.fit(good[:200].astype(np.float32), np.concatenate([good[200:], bad]).astype(np.float32), 0.35)
    assert (model.scores(good) > 0.5).mean() > 0.95 and (model.scores(bad) < 0.5).mean() > 0.95
