import hashlib
import random

import pytest

from schemaloom.llm import suffix as S


def brute(rows, length):
    """doc_id -> (bytes, removed, spans, sha256) by looking at every window in order."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


def digest(df):
    out = {}
    for r in df.collect():
        out[r[0]] = (r["n_bytes"], sum(x["end"] - x["start"] for x in r["removed"]), len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest())
    return out


def test_documents_against_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.op7_suffix_dedup(spark, sf).collect()}
    assert got == brute(rows, 100)


@pytest.mark.parametrize(("limit", "keys"), [(1500, 1 << 20), (3, 1 << 20), (3, 0), (1, 0)])
def test_shared_passages_and_periodic_texts(spark, limit, keys):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 60, 90)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40)))]
        for p in passages:
            if rng.random() < 0.7:
                cut = rng.randrange(len(p) // 3)
                parts += [p[cut:], " ".join(word() for _ in range(rng.randrange(0, 30)))]
        rows.append((i, " ".join(parts)))
    rows += [(100, "a" * 700), (101, "ab" * 400), (102, "a" * 99), (103, None), (104, ""), (105, "a" * 100), (106, rows[0][1]), (107, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, th string, start long")
    assert digest(S.drop_repeats(docs, group_limit=limit, filter_keys=keys)) == brute(rows, 100)


def test_repeated_rows_and_empty_table(spark):
    t = "some words that are long enough to be a repeat if only they were found in another document, but they are not"
    docs = spark.createDataFrame([(1, t), (1, t), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["removed"])) for r in S.drop_repeats(docs).collect()) == [(0, 0), (1, 0), (1, 0)]
    assert S.drop_repeats(docs.limit(0)).count() == 0


def test_ids_of_another_type_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 1000)
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=9000))
    rows = [("b", long), ("a", long[2000:2600] + "x" + long[100:1500]), ("c", long), ("d", long[:5000] + long[4000:])]
    assert digest(S.drop_repeats(spark.createDataFrame(rows, "doc_id string, text string"))) == brute(rows, 100)


def test_maximal_repeats_by_definition():
    rng = random.Random(8)
    for _ in range(60):
        strings = ["".join(rng.choices(rng.choice(["ab", "a\0"]), k=rng.randrange(0, 30))).encode() for _ in range(rng.randrange(1, 6))]
        got = {(n, tuple(sorted(zip(s.tolist(), o.tolist(), strict=True)))) for n, s, o in S.repeat_groups_of(strings, 3)}
        where: dict[bytes, list] = {}
        for s, t in enumerate(strings):
            for a in range(len(t)):
                for b in range(a + 3, len(t) + 1):
                    where.setdefault(t[a:b], []).append((s, a))
        want = set()
        for x, occ in where.items():
            if len(occ) > 1:
                left = {strings[s][a - 1] if a else (s, a) for s, a in occ}
                right = {strings[s][a + len(x)] if a + len(x) < len(strings[s]) else (s, a) for s, a in occ}
                if len(left) > 1 and len(right) > 1:
                    want.add((len(x), tuple(sorted(occ))))
        assert got == want


@pytest.mark.parametrize("limit", [1500, 2])
def test_repeat_groups_hold_all_occurrences(spark, limit):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randrange(2, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (25, 40, 70)]
    rows = []
    for i in range(25):
        parts = [" ".join(word() for _ in range(rng.randrange(5, 30)))]
        for p in passages:
            if rng.random() < 0.6:
                parts += [p[rng.randrange(len(p) // 4) :], " ".join(word() for _ in range(rng.randrange(0, 20)))]
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[0][1]), (51, "ab" * 150), (52, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for r in S.repeat_groups(docs, group_limit=limit).collect():
        groups.setdefault((r["group_id"], r["length"]), set()).add((r["doc_id"], r["start"]))
    gone = {i: set() for i in text}
    for (_, n), where in groups.items():
        assert n >= 100
        assert len(where) > 1
        assert len({text[i][s : s + n] for i, s in where}) == 1
        for i, s in where - {min(where)}:
            gone[i] |= set(range(s, s + n))
    want = {r["doc_id"]: {b for x in r["removed"] for b in range(x["start"], x["end"])} for r in S.drop_repeats(docs).collect()}
    assert gone == want
